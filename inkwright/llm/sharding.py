"""Operator 1, sharding by sampled splitters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_hash, materialize, utf8_size
from .ranges import RangePlan, plan_ranges

#: Bytes of records in a range; a range is what one task sorts.
RANGE_BYTES = 256 << 20


@dataclass
class Sharded:
    """records: every input row with ``shard`` and ``slot``; plan: the ranges behind them."""

    records: DataFrame
    plan: RangePlan
    n_shards: int


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 24, overhead: int = 8, range_bytes: int = RANGE_BYTES, ranges_per_shard: int = 16) -> Sharded:
    """Put all rows into ``n_shards`` shards of near equal bytes, contiguous in the order of ``key``.

    A size-weighted key sample gives quantile splitters; records are range-partitioned by them, and
    overfull ranges are subdivided. Exact sums along the ranges then place each record: shard
    boundaries fall where the running size passes a multiple of total / n_shards, so that shards
    differ from that by at most half of a record at either end.

    Size: UTF-8 bytes of the text plus ``overhead``. Null text counts as no bytes. Null keys come
    first. Rows of one key are ordered by a hash of the whole row, then by their place in the
    input; a key with a third of all rows is split like any other. Equal rows are told apart by
    place only and may change slots with each other. An empty table gives no rows. Extra columns
    are kept, whatever their names; columns named shard, slot or size are replaced. df is read twice
    and must give the same rows in the same partitions each time, as tables do.
    """
    df = df.drop("shard", "slot", "size")
    # the row travels as one struct, so that no column's name clashes with those worked with here
    row = F.struct(*[f"`{c}`" for c in df.columns])
    keyed = df.select(row.alias("row"), F.col(key).alias("key"), (utf8_size(text) + overhead).alias("size"), content_hash(df).alias("h"), F.monotonically_increasing_id().alias("i"))
    order = ["key", "h", "i"]
    slim = materialize(keyed.select(*order, "size"), "shard-keys")
    plan = plan_ranges(slim, order, "size", range_bytes, min_ranges=n_shards * ranges_per_shard)
    total = max(1, plan.total)
    at = F.expr(f"cast(least({n_shards - 1}, (2 * __before + size) * {n_shards} div (2 * {total})) as int)")
    firsts = dict(plan.prefix(slim, "__before", "__index").groupBy(at.alias("shard")).agg(F.min("__index")).collect())
    first = F.create_map(*[F.lit(x) for kv in sorted(firsts.items()) for x in kv]) if firsts else F.create_map(F.lit(0), F.lit(0))
    placed = plan.prefix(keyed, "__before", "__index").withColumn("shard", at)
    placed = placed.withColumn("slot", F.col("__index") - F.element_at(first.cast("map<int,bigint>"), F.col("shard")))
    return Sharded(placed.select("row.*", "size", "shard", "slot"), plan, n_shards)


def write_shards(sharded: Sharded, path: str) -> None:
    """Write one folder per shard, ordered by slot. A shard spreads over as many tasks as it has ranges of slots."""
    df = sharded.records
    out = df.repartitionByRange(max(sharded.n_shards, len(sharded.plan.rows)), "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def digest(sharded: Sharded, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The facts of a sharding that can be checked without its texts."""
    return sharded.records.select(
        key, "size", F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
