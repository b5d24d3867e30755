"""Operator 6, near-duplicate embeddings by small-world graphs per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .topk import _finite

#: Different vectors in a shard; a task holds two shards and their matrix of hits.
SHARD = 8192


def _matrix(v: list) -> np.ndarray:
    dim = max(map(len, v))
    out = np.zeros((len(v), dim))
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def _spans(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each row and each column of a matrix of links, by number; -1 without links."""
    rows, cols = np.full(len(hits), -1), np.full(hits.shape[1], -1)
    some = hits.any(1)
    for i in np.flatnonzero(some):
        if rows[i] >= 0:
            continue
        front = np.array([i])
        rows[i] = i
        while len(front):
            reach = np.flatnonzero(hits[front].any(0) & (cols < 0))
            cols[reach] = i
            front = np.flatnonzero(hits[:, reach].any(1) & (rows < 0)) if len(reach) else reach
            rows[front] = i
    return rows, cols


def _weighed(hits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """hits @ weights, row blocks at a time: the product widens the bits it reads."""
    return np.concatenate([hits[k : k + 256] @ weights for k in range(0, len(hits), 256)])


def link(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vec: str = "embedding", label: str = "label", shard: int = SHARD, beam: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of df.

    Rows link when their labels are equal and not null and the cosine in double precision is at
    least ``threshold``. n_links counts the other rows linked directly; component_id is the
    smallest id reachable, the row's own included; kept rows are those named by their component.
    Vectors that are null, zero, or hold null or non-finite components link with nothing; shorter
    vectors count as padded with zeros. Rows without an id link but name no component unless none
    of theirs has one, and aren't kept. Rows that repeat an id are rows of their own.

    Equal vectors of a label (by 128 bits of hash) are one node with a count, however many there
    are. The nodes of a label are hashed into shards; each shard is indexed by a navigable
    small-world graph, and every shard is searched by the nodes of each other shard of the label,
    once for each pair of shards. Beams widen until an audit against exact neighbours of a sample
    passes, in which no vector counts as its own neighbour; hits
    are checked in double precision, and each pair of shards returns counts and a spanning forest,
    not its links. Components are then united. An empty table gives no rows; extra columns play
    no part.
    """
    return _link(df, threshold, key, vec, label, shard, beam)[0]


def audited(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vec: str = "embedding", label: str = "label", shard: int = SHARD, beam: int = 64) -> tuple[int, int, float]:
    """Links between different vectors that the graph walks of link() found, and true ones, of the
    queries that audits looked at, over all shards; and the share of all pairs that audits multiplied."""
    told = _link(df, threshold, key, vec, label, shard, beam)[1]
    found, true, scanned, pairs = told.agg(*[F.sum(c) for c in ("found", "true", "scanned", "pairs")]).first()
    return found or 0, true or 0, (scanned or 0) / (pairs or 1)


def _link(df: DataFrame, threshold: float, key: str, vec: str, label: str, shard: int, beam: int) -> tuple[DataFrame, DataFrame]:
    rows = materialize(
        df.select(F.col(key).alias("id"), F.col(vec).alias("v"), F.col(label).alias("label"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("ok", F.coalesce(_finite("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False)))
        .withColumn("h1", F.xxhash64("v"))
        .withColumn("h2", F.xxhash64(F.lit(1), "v", F.lit(2))),
        "embed-rows",
    )
    node = ["label", "h1", "h2"]
    nodes = materialize(rows.filter("ok").groupBy(*node).agg(F.min("id").alias("first"), F.min("uid").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")), "embed-nodes")
    parts = nodes.groupBy("label").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = nodes.join(parts, "label").withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.col("shards")).cast("int"))
    kind = dict(rows.dtypes)["label"]

    def build(key, table):
        import pyarrow as pa

        from .hnsw import Hnsw

        table = table.sort_by("node")
        x = _matrix(table.column("v").to_pylist())
        unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        pack = lambda a, t: pa.array([a.astype(t).tobytes()], pa.binary())
        return pa.table({"label": table.column("label").slice(0, 1).combine_chunks(), "shard": pa.array([key[1].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "nodes": pack(table.column("node").to_numpy(), "<i8"), "counts": pack(table.column("n").to_numpy(), "<i8"), "v": pack(x, "<f4" if np.array_equal(x.astype("<f4"), x) else "<f8"), "wide": [not np.array_equal(x.astype("<f4"), x)], "graph": pa.array([Hnsw.build(unit).dump()], pa.binary())})

    shards = materialize(dealt.groupBy("label", "shard").applyInArrow(build, f"label {kind}, shard int, dim int, nodes binary, counts binary, v binary, wide boolean, graph binary"), "embed-shards")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .hnsw import Hnsw, within

        names = ["node", "links", "root", "found", "true", "scanned", "pairs"]
        for batch in batches:
            for r in batch.to_pylist():
                sides = []
                for s in "ab":
                    x = np.frombuffer(r[f"{s}_v"], "<f8" if r[f"{s}_wide"] else "<f4").reshape(-1, r[f"{s}_dim"]).astype(np.float64)
                    sides.append((np.frombuffer(r[f"{s}_nodes"], "<i8"), np.frombuffer(r[f"{s}_counts"], "<i8"), x))
                dim = max(s[2].shape[1] for s in sides)
                (na, ca, xa), (nb, cb, xb) = ((i, c, np.pad(x, ((0, 0), (0, dim - x.shape[1])))) for i, c, x in sides)
                # lengths by a scaled sum, so that tiny or huge vectors neither vanish nor overflow
                unit = lambda x: (y := x / np.abs(x).max(1, keepdims=True)) / np.sqrt((y * y).sum(1))[:, None]
                ua, ub = unit(xa), unit(xb)
                graph = Hnsw.load(ua.astype(np.float32), r["a_graph"])
                got = within(graph, ub.astype(np.float32), threshold, lambda i, j: np.einsum("kd,kd->k", ub[i], ua[j]), beam, own=r["same"])
                hits = got.linked
                if r["same"]:
                    np.fill_diagonal(hits, True)  # a node's row and its column are one
                    root = na[_spans(hits)[0]]
                    np.fill_diagonal(hits, False)
                    nodes, counts = na, _weighed(hits, ca)
                else:
                    rows, cols = _spans(hits)
                    nodes, counts, root = np.r_[na, nb], np.r_[_weighed(hits.T, cb), _weighed(hits, ca)], nb[np.r_[cols, rows]]
                some = counts > 0
                none = np.zeros(int(some.sum()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(counts[some].astype(np.int64)), pa.array(root[some])] + [pa.array(none)] * 4, names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([x], pa.int64()) for x in (got.found, got.true, got.scanned, hits.size)], names)

    side = lambda s: shards.select("label", *[F.col(c).alias(f"{s}_{c}") for c in ("shard", "dim", "nodes", "counts", "v", "wide", *(["graph"] if s == "a" else []))])
    pairs = side("a").join(side("b"), "label").filter("a_shard <= b_shard").withColumn("same", F.expr("a_shard = b_shard")).drop("label")
    told = materialize(pairs.repartition(F.col("a_nodes"), F.col("b_nodes")).mapInArrow(compare, "node long, links long, root long, found long, true long, scanned long, pairs long"), "embed-links")
    found = told.filter("node is not null").select("node", "links", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = materialize(connected_components(found, "node", "root"), "embed-components")
    named = nodes.select("node", "first").join(comps, "node").groupBy("component").agg(F.min("first").alias("smallest"))
    named = comps.join(named, "component").select("node", "smallest")
    facts = nodes.select(*node, "node", "n", "first").join(counts, "node", "left").join(named, "node", "left").select(*node, F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("smallest", "first").alias("smallest"))
    out = rows.drop("v").join(facts, [*node, "ok"], "left")
    component = F.when(F.col("ok"), F.col("smallest")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
    return out, told.select("found", "true", "scanned", "pairs")


ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON l.a = c.reach),
m AS (SELECT node, min(reach) AS component_id FROM c GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, d.vec_id = m.component_id AS kept
FROM embeddings d JOIN m ON m.node = d.vec_id LEFT JOIN n ON n.a = d.vec_id
"""
