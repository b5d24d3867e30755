"""Near-duplicates by the Jaccard similarity of word shingles: SimHash with pigeonring filtering first,
a prefix filter for what it can't promise, and an exact check.

Sets of a similarity of 0.8 differ in some 15 % of the bits of their fingerprints. A pigeonring of so
wide a budget excludes next to nothing, so it links what is within BITS, and documents that are still
apart meet by shared shingles of their prefixes, which misses no pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, release, slices, small_batches, unused
from .components import connected_components
from .simhash import BLOCK, SEED, majority
from .simhash import links as simhash_links

#: Buckets of a shared shingle up to this many different sets are joined pair by pair.
BUCKET = 256
#: Documents sampled for the order of shingles, sampled documents from which a shingle is common, and
#: the common shingles kept. They set the cost only: any order gives the same links.
SAMPLE, COMMON, KEPT = 8192, 4, 1 << 16
#: Budget of the fingerprints' first links, and their buckets; they set the cost only.
BITS, BITS_BUCKET = 2, 64
#: Shingles of a prefix that are tried alone; it sets the cost only.
FEW = 16
#: Words of 64 bits in a parity bitmap.
PARITY = 8


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles, ascending; words as in simhash.fingerprint."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((hash_(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n shingles, rare ones first, then by hash.

    Sets of a Jaccard similarity of 0.8 or more share 0.8 of the shingles of either one at least, so
    their prefixes in one common order share a shingle.
    """
    n = len(found)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))]
    return found[: n - -(-4 * n // 5) + 1]


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap of the parities of how many shingles fall on each bit. Two bitmaps differ in no
    more bits than their sets have shingles that only one of them holds."""
    ones = np.bincount((found & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def sketch(found: np.ndarray) -> bytes:
    """Parities as in parity(), on two bits or more for each shingle, so that long sets tell apart too."""
    n = max(64 * PARITY, 1 << max(0, 2 * len(found) - 1).bit_length())
    ones = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, ascending, and their counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, width).view(np.int64))], ["h"])

    part = rows.sample(min(1.0, SAMPLE / max(1, rows.count())), seed=SEED).select("text")
    top = part.mapInArrow(run, "h bigint").groupBy("h").count().filter(F.col("count") >= COMMON)
    got = top.orderBy(F.desc("count"), "h").limit(KEPT).toArrow()  # as columns, not as a row each
    found, counts = got["h"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """A written table: doc_id, uid, set (hash of the shingle set), fp (its SimHash), n, sketch, prefix, p0 and on (parity)."""
    common, counts = _common(rows, width)
    names = ["doc_id", "uid", "set", "fp", "n", "sketch", "prefix", *[f"p{i}" for i in range(PARITY)]]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            found = [shingles(t, width) for t in batch.column(2).to_pylist()]
            bits = np.array([parity(x) for x in found], np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array(np.array([majority(x[k : k + BLOCK] for k in range(0, len(x), BLOCK)) for x in found], np.uint64).view(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary()),
                pa.array([prefix(x, common, counts).view(np.int64) for x in found], pa.list_(pa.int64())), *[pa.array(bits[:, i].copy()) for i in range(PARITY)],
            ], names)

    kind = dict(rows.dtypes)["doc_id"]
    with small_batches(rows.sparkSession):
        return materialize(rows.mapInArrow(run, f"doc_id {kind}, uid bigint, set binary, fp bigint, n bigint, sketch binary, prefix array<bigint>, " + ", ".join(f"p{i} bigint" for i in range(PARITY))), "shingles")


def _verified(rows: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """A written table of those pairs a, b whose shingle sets have a Jaccard similarity of 0.8 or more.

    Sketches, a sixteenth of the sets' size, exclude most others before sets travel.
    """
    side = lambda c, v: sketches.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(v))

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            na, nb, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [9 * apart(u, v) <= i + j for i, j, u, v in zip(na, nb, x, y)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    pairs = materialize(pairs.select("a", "b", "na", "nb", "x", "y").mapInArrow(near, "a bigint, b bigint"), "shingles-pairs")
    nodes = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            found = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["uid", "s"])

    sets = materialize(rows.select("uid", "text").join(nodes, "uid", "left_semi").mapInArrow(run, "uid bigint, s array<bigint>"), "shingles-sets")
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("s").alias("y")), "b")
    # shared / (nx + ny - shared) >= 4 / 5
    similar = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    out = materialize(both.filter(similar).select("a", "b"), "shingles-links")
    drop_scratch(pairs, sets)
    return out


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and parities of the structs a and b leave a similarity of 0.8 possible."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY)])
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * apart <= na + nb)


def links(rows: DataFrame, nodes: DataFrame, width: int = 5, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of uids that connect all of ``nodes`` with a similarity of 0.8 or more.

    Sets are compared in three steps, each only where documents aren't connected yet, so that sets
    travel about once for each near copy. First all of a group of fingerprints within BITS of each
    other meet the group's smallest uid. Then a FEW shingles of each prefix are tried, from the
    commonest on, as edits make rare ones; each has a centre of its own that its documents meet, so
    a group is tried from many sides. Last, only shingles that stand in several components are
    looked at, all that stand in the same documents as one bucket: in one of up to ``bucket`` documents
    those still apart meet pair by pair; in a
    larger one those outside the bucket's largest component meet the others. A pair is a candidate
    where its first common shingle leaves room for enough common ones. Every link is checked on the
    whole sets.
    """
    head = materialize(nodes.groupBy("fp").agg(F.min("uid").alias("head")), "shingles-heads")
    near = materialize(connected_components(simhash_links(head.select("fp"), BITS, BITS_BUCKET)), "shingles-near")
    grouped = head.join(near, F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("component", "fp").alias("c"))
    first = materialize(grouped.join(grouped.groupBy("c").agg(F.min("head").alias("first")), "c").select("fp", "first"), "shingles-first")
    found = _verified(rows, nodes, nodes.select("uid", "fp").join(first, "fp").filter("uid <> first").select(F.col("first").alias("a"), F.col("uid").alias("b")), width)
    drop_scratch(head, near, first)

    def parted(*columns) -> tuple[DataFrame, DataFrame]:
        """Nodes with the component they are in by now."""
        parts = materialize(connected_components(found), "shingles-parts")
        release(rows.sparkSession)
        return parts, nodes.join(parts, F.col("uid") == F.col("node"), "left").select("uid", F.coalesce("component", "uid").alias("part"), *columns)

    parts, early = parted(F.explode(F.slice(F.reverse("prefix"), 1, FEW)).alias("h"))
    centre = early.groupBy("h").agg(F.min_by(F.struct("uid", "part"), F.xxhash64("h", "uid")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    star = early.join(centre, "h").filter("part <> c.part").select(F.least("uid", "c.uid").alias("a"), F.greatest("uid", "c.uid").alias("b"))
    found = found.union(_verified(rows, nodes, star, width))
    drop_scratch(parts)

    parts = materialize(connected_components(found), "shingles-parts")
    release(rows.sparkSession)
    # a first exchange of 48 bits and a count only drops shingles that stand in one document
    keyed, short = nodes.select("uid", F.posexplode("prefix").alias("pos", "h")), lambda h: F.shiftright(h, 16)
    shared = keyed.groupBy(short(F.col("h")).alias("k")).agg(F.count("*").alias("m")).filter("m > 1").select("k").hint("merge")
    stands = materialize(keyed.join(shared, short(F.col("h")) == F.col("k"), "left_semi"), "shingles-shared")
    parted_rows = stands.join(parts, F.col("uid") == F.col("node"), "left").select("h", "uid", "pos", F.coalesce("component", "uid").alias("part"))
    # shingles that stand in the same documents, as those of a passage do, make one bucket: its
    # documents are told by two 64-bit sums, and a pair meets there once, at its first places, which
    # bound what it can share no less than the places of its first common shingle
    members = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "uid"))
    same = parted_rows.groupBy("h").agg(F.count("*").alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi"), members(1).alias("g"), members(2).alias("g2")).filter("lo <> hi").drop("lo", "hi")
    once = parted_rows.join(same, "h").groupBy("uid", "g", "g2").agg(F.min("pos").alias("pos"), F.first("part").alias("part"), F.first("m").alias("m"))
    info = nodes.select("uid", F.struct("uid", "n", *[f"p{i}" for i in range(PARITY)]).alias("x"))
    cand = materialize(once.join(info, "uid").select("g", "g2", "m", "pos", "x", "part"), "shingles-candidates")
    light, heavy = cand.filter(F.col("m") <= bucket), cand.filter(F.col("m") > bucket)

    def pairs(left: DataFrame, right: DataFrame, more: Column) -> DataFrame:
        right = right.select(F.col("g").alias("k"), F.col("g2").alias("k2"), F.col("pos").alias("at"), F.col("x").alias("y"), F.col("part").alias("theirs"))
        # if this is the first common shingle, so many can be common at most; 4/9 of all must be
        room = F.least(F.col("x.n") - F.col("pos"), F.col("y.n") - F.col("at"))
        on = (left["g"] == right["k"]) & (left["g2"] == right["k2"])
        near = left.join(right, on & more & (F.col("part") != F.col("theirs")) & (9 * room >= 4 * (F.col("x.n") + F.col("y.n"))) & _may_link("x", "y"))
        return near.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))

    out = pairs(light, light, F.col("x.uid") < F.col("y.uid"))
    if heavy.limit(1).count():
        sizes = heavy.groupBy("g", "g2", "part").agg(F.count("*").alias("n")).groupBy("g", "g2").agg(F.max(F.struct("n", "part")).alias("top"))
        outside = materialize(heavy.join(sizes, ["g", "g2"]).filter(F.col("part") != F.col("top.part")).select("g", "g2", "pos", "x", "part"), "shingles-outside")
        out = out.union(pairs(outside, heavy, F.lit(True)))
    found = found.union(_verified(rows, nodes, out, width))
    drop_scratch(stands, cand, parts)
    return found


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, bucket: int = BUCKET) -> DataFrame:
    """The rows of df without near-duplicates: of each group the row with the smallest key stays.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of 0.8 or more are linked (see
    links), and groups are what links connect. Fewer words make one shingle; null and texts without words
    are equal. Null keys come last. df is read several times and must give the same rows in the same
    partitions each time, as tables do.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    found = _sketches(rows, width)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    # equal sets are one node, so that copies cost one row, whatever their number
    classes = materialize(found.groupBy("set").agg(F.min(order).alias("first")).select("first"), "shingles-classes")
    nodes = materialize(found.join(classes.select(F.col("first.uid").alias("uid")), "uid", "left_semi").drop("doc_id", "set"), "shingles-nodes")
    drop_scratch(found)
    parts = materialize(connected_components(links(rows, nodes, width, bucket)), "shingles-parts")
    linked = classes.join(parts, F.col("first.uid") == F.col("node"))
    alone = classes.join(parts, F.col("first.uid") == F.col("node"), "left_anti").select("first.uid")
    stay = materialize(alone.union(linked.groupBy("component").agg(F.min("first").alias("first")).select("first.uid")), "shingles-stay")
    mark = unused(df, "__uid")
    return df.withColumn(mark, F.monotonically_increasing_id()).join(stay.withColumnRenamed("uid", mark), mark, "left_semi").drop(mark)
