"""Operator 3, exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that pivots are chosen from, pivots, and rounds of moving them.
SAMPLE, PIVOTS, MOVES = 4096, 64, 6
#: Vectors in a block of the index (an annulus or part of one), and in a block of queries.
BLOCK, QUERY_BLOCK = 2048, 256
#: Annuli of its own cell that a query block scans before it has a bound.
FIRST = 4
#: Scores are longs; components and sums beyond them are an error, never rounded.
LONG = 1 << 63
#: Relative slack of the bounds, far above what doubles lose.
SLACK = 1e-7


def _finite(vec: str) -> Column:
    """Vectors that take part: not null, no null, NaN or infinite component."""
    ok = F.forall(vec, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.col(vec).isNotNull() & ok


def _ints(lists: list, dim: int, scale: int) -> np.ndarray:
    """floor(scale * component) as longs, shorter vectors padded with zeros."""
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if np.abs(out).max(initial=0) >= LONG:
        raise OverflowError("a scaled component does not fit a long")
    return out.astype(np.int64)


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate makes all squared lengths ``top``: the nearest is then the largest inner product."""
    return np.c_[v, np.sqrt(np.maximum(top - (v * v).sum(1), 0))]


def _scaled(q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries made as long as lifted vectors are, which leaves their order of scores and makes the
    bounds tighter; their extra coordinate is 0. And by what each was multiplied."""
    by = np.sqrt(top) / np.maximum(np.sqrt((q * q).sum(1)), 1)
    return np.c_[q * by[:, None], np.zeros(len(q))], by


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * v @ pivots.T, 0))


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Points far from each other, moved to the middle of what is nearest to them."""
    chosen = [sample[0]]
    near = _distances(sample, sample[:1])[:, 0]
    for _ in range(min(k, len(sample)) - 1):
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, _distances(sample, chosen[-1][None])[:, 0])
    pivots = np.array(chosen)
    for _ in range(MOVES):
        home = _distances(sample, pivots).argmin(1)
        pivots = np.array([sample[home == j].mean(0) if (home == j).any() else p for j, p in enumerate(pivots)])
    return pivots


def _dot(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, in longs while it stays
    below 2**63, else in Python's integers. A product that is no long is an error, but for the
    pairs ``own``, whose products don't count."""
    high = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
    most = high(a) * high(b) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < LONG:
        return a @ b.T
    out = a.astype(object) @ b.astype(object).T
    out[own] = 0
    if out.size and max(-int(out.min()), int(out.max())) >= LONG:
        raise OverflowError("an inner product does not fit a long")
    return out.astype(np.int64)


class _Best:
    """The k best (score, smaller id) of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Results in flat arrays: query number, score, id."""
        keep = scores >= self.scores[q, -1]
        q, scores, ids = q[keep], scores[keep], ids[keep]
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, ~scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        first = np.searchsorted(q, touched)
        take = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = scores[take], ids[take]

    def scan(self, mat: np.ndarray, ids: np.ndarray, some: np.ndarray) -> None:
        """Scores of the queries ``some`` with the vectors ``ids``; the least long marks pairs that don't count."""
        cut = self.scores[some, -1]
        if mat.shape[1] > self.k:
            cut = np.maximum(cut, np.partition(mat, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((mat >= cut[:, None]) & (mat > np.iinfo(np.int64).min))
        if len(q):
            self.add(some[q], mat[q, c], ids[c])


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` highest integer inner products.

    Components are floor(scale * x), exact as longs; candidates are all rows but the query's own,
    ties go to the smaller id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. Shorter vectors count as padded with zeros. Repeated ids and equal
    vectors are rows of their own. Fewer than k candidates: all of them. An empty table gives no rows;
    extra columns play no part. A component or a score that does not fit a long raises OverflowError.

    Index: each vector, lifted so that inner products order like distances, is keyed by its nearest
    pivot and its distance from it; sorting by that key and cutting gives annuli of bounded size,
    also where a third of all vectors are equal. A block of queries scans the annuli of its own
    cell that are nearest to it, which bounds what can still enter each query's results; then it
    expands over all cells into every annulus that the triangle inequality does not exclude for
    some query, and multiplies it with those queries only. Pivots come from a bounded sample; any
    pivots give the same, exact result.
    """
    return _search(df, is_query, key, vec, k, scale)[0]


def share_scanned(df: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = 10, scale: int = 1024) -> float:
    """The share of all (query, vector) pairs that search() multiplies; the bounds exclude the others."""
    _, queries, vectors, states = _search(df, is_query, key, vec, k, scale)
    return sum(s.agg(F.sum("pairs")).first()[0] or 0 for s in states) / max(1, queries * vectors)


def _search(df: DataFrame, is_query: Column, key: str, vec: str, k: int, scale: int) -> tuple[DataFrame, int, int, list[DataFrame]]:
    rows = materialize(df.filter(_finite(vec) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), is_query.alias("q")).withColumn("uid", F.monotonically_increasing_id()), "topk-rows")
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + whole(x) * whole(x))
    n, n_queries, dim, top, most = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", lambda x: F.abs(whole(x)))))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long"), 0, 0, []
    dim, top, code = max(dim, 1), top * (1 + 1e-12) + 1, "<i4" if (most or 0) < 1 << 31 else "<i8"
    sample = rows.select("v", "uid").orderBy(F.xxhash64("uid")).limit(SAMPLE).collect()
    pivots = _pivots(_lift(_ints([r[0] for r in sample], dim, scale).astype(np.float64), top), max(1, min(PIVOTS, int(n**0.5 / 4) + 1)))

    def vectors(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, code).reshape(-1, dim).astype(np.int64)

    def locate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            v = _ints(b.column(1).to_pylist(), dim, scale)
            far = _distances(_lift(v.astype(np.float64), top), pivots)
            home = far.argmin(1)
            flat = pa.array([x.tobytes() for x in v.astype(code)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(v)), home]), flat], ["id", "q", "uid", "cell", "far", "v"])

    index = materialize(rows.mapInArrow(locate, "id long, q boolean, uid long, cell int, far double, v binary"), "topk-index")

    def blocked(part: DataFrame, size: int, asked: bool) -> DataFrame:
        """Runs of ``size`` rows of one cell in the order of their distance; of queries, whose extra
        coordinate is 0, also the distances of each from every pivot."""

        def cut(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held, names = None, ["block", "cell", "lo", "hi", "ids", "uids", "v", "dist"]

            def emit(t):
                blob = b"".join(t.column("v").to_pylist())
                far = _distances(_scaled(vectors(blob).astype(np.float64), top)[0], pivots).T.tolist() if asked else None
                one = [t.column("uid")[0].as_py(), t.column("cell")[0].as_py(), t.column("far")[0].as_py(), t.column("far")[-1].as_py(), t.column("id").to_pylist(), t.column("uid").to_pylist(), blob, far]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.float64()))]
                return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(one, kinds)], names)

            for b in batches:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                cells = t.column("cell").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
                held = None
                for a, z in zip(edges, edges[1:]):
                    for s in range(a, z, size):
                        if z == len(cells) and z - s <= size:
                            held = t.slice(s)
                        else:
                            yield emit(t.slice(s, min(size, z - s)))
            if held is not None and held.num_rows:
                yield emit(held)

        order = ["cell", "far", "id", "uid"]
        ranged = part.repartitionByRange(part.count() // (8 * size) + 1, *order).sortWithinPartitions(*order)
        return materialize(ranged.select("id", "uid", "cell", "far", "v").mapInArrow(cut, "block long, cell int, lo double, hi double, ids array<long>, uids array<long>, v binary, dist array<array<double>>"), "topk-blocks")

    annuli, asked = blocked(index, BLOCK, False), blocked(index.filter("q"), QUERY_BLOCK, True)
    catalog = annuli.select(F.col("block").alias("annulus"), "cell", "lo", "hi")
    near = asked.select("block", F.col("cell").alias("own"), F.posexplode("dist").alias("cell", "dist"))
    # how far each query of a block is from an annulus, at least
    gaps = F.transform("dist", lambda d: F.greatest(F.lit(0.0), F.col("lo") - d, d - F.col("hi")))
    pairs = near.join(catalog, "cell").withColumn("gaps", gaps).drop("dist")

    def visit(pairs: DataFrame, state: DataFrame | None) -> DataFrame:
        """Scan the pairs (block, annulus); the new best of each block, how far each query still has to
        look, and how many pairs of vectors were multiplied."""
        q = asked.select("block", F.col("uids").alias("q_uids"), F.col("v").alias("q_v"))
        if state is not None:
            q = q.join(state.select("block", "scores", "reach"), "block")
        else:
            q = q.select("*", F.lit(None).cast("binary").alias("scores"), F.lit(None).cast("array<double>").alias("reach"))
        a = annuli.select(F.col("block").alias("annulus"), "ids", "uids", "v")
        work = pairs.select("block", "annulus", "gaps").join(q, "block").join(a, "annulus")

        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            open_: dict[int, list] = {}

            def flush():
                for block, (best, pairs) in open_.items():
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([best.scores.tobytes()], pa.binary()), pa.array([best.ids.tobytes()], pa.binary()), pa.array([pairs], pa.int64())], ["block", "scores", "best", "pairs"])
                open_.clear()

            for b in batches:
                for r in b.to_pylist():
                    qv, v = vectors(r["q_v"]), vectors(r["v"])
                    if r["block"] not in open_:
                        if len(open_) >= 256:
                            yield from flush()
                        best = _Best(len(qv), k)
                        if r["scores"] is not None:
                            # what earlier rounds found bounds the scan; it is not handed on from here
                            best.scores[:] = np.frombuffer(r["scores"], np.int64).reshape(-1, k)[:, -1:]
                        open_[r["block"]] = [best, 0]
                    some = np.arange(len(qv)) if r["reach"] is None else np.flatnonzero(np.array(r["gaps"]) <= np.array(r["reach"]))
                    own = np.array(r["q_uids"])[some][:, None] == np.array(r["uids"])
                    mat = _dot(qv[some], v, own)
                    mat[own] = np.iinfo(np.int64).min
                    open_[r["block"]][0].scan(mat, np.array(r["ids"]), some)
                    open_[r["block"]][1] += mat.size
            yield from flush()

        # by annulus: its vectors travel once, the few queries of a block with each pair
        found = work.select("block", "gaps", "q_uids", "q_v", "scores", "reach", "uids", "ids", "v").mapInArrow(scan, "block long, scores binary, best binary, pairs long")
        if state is not None:
            found = found.union(state.select("block", "scores", "best", F.lit(0).cast("long")))

        def merge(key, table):
            import pyarrow as pa

            blobs = [(np.frombuffer(s.as_py(), np.int64).reshape(-1, k), np.frombuffer(i.as_py(), np.int64).reshape(-1, k)) for s, i in zip(table.column("scores"), table.column("best"))]
            best = _Best(len(blobs[0][0]), k)
            for s, i in blobs:
                real = i < np.iinfo(np.int64).max
                q = np.nonzero(real)[0]
                if len(q):
                    best.add(q, s[real], i[real])
            qv, by = _scaled(vectors(table.column("q_v")[0].as_py()).astype(np.float64), top)
            worst = best.scores[:, -1].astype(np.float64)
            worst[best.ids[:, -1] == np.iinfo(np.int64).max] = -np.inf
            # an unseen vector can enter a query's results only if its squared distance is at most this
            reach = np.sqrt(np.maximum((qv * qv).sum(1) + top - 2 * by * worst, 0)) * (1 + SLACK) + SLACK * np.sqrt(top)
            pairs = sum(table.column("pairs").to_pylist())
            return pa.table({"block": [key[0].as_py()], "scores": pa.array([best.scores.tobytes()], pa.binary()), "best": pa.array([best.ids.tobytes()], pa.binary()), "reach": pa.array([reach.tolist()], pa.list_(pa.float64())), "pairs": pa.array([pairs], pa.int64())})

        rows = found.join(asked.select("block", F.col("v").alias("q_v")), "block")
        return materialize(rows.groupBy("block").applyInArrow(merge, "block long, scores binary, best binary, reach array<double>, pairs long"), "topk-best")

    rank = F.row_number().over(W.partitionBy("block").orderBy(F.array_min("gaps"), "annulus"))
    first = materialize(pairs.filter("cell = own").withColumn("rank", rank).filter(F.col("rank") <= FIRST).select("block", "annulus", "gaps"), "topk-first")
    # blocks of a cell without annuli can't exist: a query is a candidate for others, so its cell has one
    states = [visit(first, None)]
    open_ = F.exists(F.zip_with("gaps", "reach", lambda g, r: g <= r), lambda x: x)
    rest = pairs.join(states[0].select("block", "reach"), "block").filter(open_).select("block", "annulus", "gaps").join(first, ["block", "annulus"], "left_anti")
    rest = materialize(rest, "topk-rest")
    if rest.limit(1).count():
        states.append(visit(rest, states[0]))

    def unfold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                s, i = (np.frombuffer(r[c], np.int64).reshape(-1, k) for c in ("scores", "best"))
                q, rank = np.nonzero(i < np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["ids"])[q]), pa.array((rank + 1).astype(np.int32)), pa.array(i[q, rank]), pa.array(s[q, rank])], ["query_id", "rank", "vec_id", "score"])

    out = states[-1].join(asked.select("block", "ids"), "block").mapInArrow(unfold, "query_id long, rank int, vec_id long, score long")
    return out, n_queries, n, states


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
