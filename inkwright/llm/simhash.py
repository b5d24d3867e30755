"""Operator 10, SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import connected_components

SEED = 42
#: Shingles counted at once; bounds the memory that a very long text takes.
BLOCK = 1 << 15
#: Buckets of a chain up to this many different fingerprints are joined pair by pair; the members of
#: larger ones meet through fingerprints between them, without loss.
BUCKET = 256


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for found in blocks:
        ones += np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(found)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of word shingles, as an unsigned integer.

    A-Z become lower case; words are runs of bytes other than ASCII white space; shingles of
    ``width`` words are joined by a space, repeats counted; fewer words make one shingle. Null and
    texts without words give 0.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    hash_ = xxhash.xxh64_intdigest
    return majority(np.array([hash_(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], np.uint64) for k in range(0, n, BLOCK))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """A written table: doc_id, uid (tells rows apart), fp (the fingerprint's bits as a long)."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            fp = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "uid", "fp"])

    return materialize(rows.mapInArrow(run, f"doc_id {kind}, uid bigint, fp bigint"), "simhash")


def _boxes(bits: int) -> list[int]:
    """Masks of the 2 * bits + 1 segments of a fingerprint, as signed longs.

    With that many segments a chain of two may differ in 2 * bits / (2 * bits + 1) < 1 bits, so
    some two consecutive segments (the last is followed by the first) are equal in any pair that
    differs in ``bits`` bits at most.
    """
    m = 2 * bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [_signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _chain(boxes: list[int], start: int, length: int) -> int:
    out = 0
    for j in range(length):
        out |= boxes[(start + j) % len(boxes)] & (1 << 64) - 1
    return _signed(out)


def _flipped(rows: DataFrame, times: int) -> DataFrame:
    """i, k, fp, v: each fingerprint under every value of its free bits that is up to ``times`` flips away."""
    out = rows.select("i", "k", "free", "fp", F.col("fp").alias("v"))
    for _ in range(times):
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
        flips = F.filter(flips, lambda f: F.col("free").bitwiseAND(f) != 0)
        out = out.select("i", "k", "free", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("f"), "v").select("i", "k", "free", "fp", F.col("v").bitwiseXOR(F.col("f")).alias("v"))
    return out.select("i", "k", "fp", "v")


def links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """a, b: pairs of different fingerprints that connect all that differ in ``bits`` bits or fewer.

    fps: a written table of distinct ``fp``. A fingerprint is cut into 2 * bits + 1 segments. Pairs
    that differ in ``bits`` bits at most have a segment from which every chain of segments keeps to
    its share of the budget; the chain of two must be equal, and equal chains make the buckets. In a
    bucket the pairs whose longer chains all keep to their shares go on to the full Hamming check.

    A bucket of over ``bucket`` fingerprints isn't paired. Its members are listed under every value
    that is bits // 2 flips of their other bits away, and again under those bits - bits // 2 flips
    away; two within the budget of each other meet under a value between them, one in each list. All
    in the second list of a value are tied to the smallest in the first one, which is within the
    budget of them, so no connection is lost, and the rows stay in proportion to the members.
    """
    boxes = _boxes(bits)
    m = len(boxes)
    chain = lambda i, length: F.lit(_chain(boxes, i, length))
    chains = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(chain(i, 2)).alias("k")) for i in range(m)])
    keyed = fps.select("fp", F.explode(chains).alias("c")).select("fp", "c.i", "c.k")
    shared = keyed.groupBy("i", "k").agg(F.count("*").alias("n")).filter("n > 1")
    cand = materialize(keyed.join(shared, ["i", "k"]), "simhash-candidates")
    light = cand.filter(F.col("n") <= bucket).drop("n")
    diff = F.col("fp").bitwiseXOR(F.col("b"))

    def keeps(i: int) -> Column:
        """The chains from segment i keep to their shares, short ones first, then the whole does."""
        parts = [F.bit_count(diff.bitwiseAND(chain(i, length))) <= length * bits // m for length in range(3, m)]
        return reduce(lambda a, b: a & b, [*parts, F.bit_count(diff) <= bits])

    rule = reduce(lambda other, i: F.when(F.col("i") == i, keeps(i)).otherwise(other), range(1, m), keeps(0))
    pairs = light.join(light.select("i", "k", F.col("fp").alias("b")), ["i", "k"]).filter(F.col("fp") < F.col("b"))
    out = pairs.filter(rule).select(F.col("fp").alias("a"), "b")
    heavy = cand.filter(F.col("n") > bucket)
    if heavy.limit(1).count():
        free = F.get(F.array(*[F.bitwise_not(chain(i, 2)) for i in range(m)]), F.col("i"))
        heavy = heavy.withColumn("free", free)
        least = _flipped(heavy, bits // 2).groupBy("i", "k", "v").agg(F.min("fp").alias("a"))
        tied = _flipped(heavy, bits - bits // 2).join(least, ["i", "k", "v"]).filter("a <> fp")
        out = out.union(tied.select("a", F.col("fp").alias("b")).distinct())
    return out


def groups(found: DataFrame, bits: int = 2) -> DataFrame:
    """fp, first (doc_id, uid of the group's first row: smallest doc_id, null last) for each fingerprint.

    Equal fingerprints are one node, so that copies cost one row, whatever their number. The result
    is a written table, so that a join of documents with it is one whose hot keys Spark can split.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = materialize(found.groupBy("fp").agg(F.min(order).alias("first")), "simhash-classes")
    parts = materialize(connected_components(links(classes.select("fp"), bits)), "simhash-parts")
    linked = classes.join(parts, F.col("fp") == F.col("node"))
    firsts = linked.groupBy("component").agg(F.min("first").alias("group_first"))
    named = parts.join(firsts, "component").select(F.col("node").alias("fp"), "group_first")
    return materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("first")), "simhash-groups")


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Fingerprints of ``width``-word shingles link when they differ in ``bits`` bits or fewer. Texts
    that are null or have no words share fingerprint zero and are linked like any other. Rows with
    a null doc_id keep it, link, and never name a component unless all its rows have none. Rows
    that repeat stay, one result each. An empty table gives no rows; other columns play no part.
    """
    found = fingerprints(df, key, text, width)
    named = groups(found, bits)
    return found.join(named, "fp").select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
