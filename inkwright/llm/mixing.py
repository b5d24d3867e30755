"""Operator 2, mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import content_hash, materialize, word_count
from .ranges import plan_ranges

#: Weights dealt to the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Rows (slim ones, of some 60 bytes) in a range; a range is what one task sorts.
RANGE_WORDS = 1 << 31


@dataclass
class Mixed:
    """records: each input row with size, source_size, target, copies and taken; budget in words."""

    records: DataFrame
    budget: float


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, source: str) -> DataFrame:
    """source, source_size, target: the share of all words dealt by weight, where no source gets
    more than ``cap`` times its size and the excess is dealt again by weight.

    Sources are ranked by code point, null last. Each round fixes every source that is above its
    cap; it ends when none is, after as many rounds as there are sources at most. Only sums reach
    the driver.
    """
    rank = plan_ranges(sizes.withColumn("__one", F.lit(1).cast("long")).withColumn("__null", F.col(source).isNull().cast("int")), ["__null", source], "__one", 1 << 20, min_ranges=8)
    ranked = rank.prefix(sizes.withColumn("__one", F.lit(1).cast("long")).withColumn("__null", F.col(source).isNull().cast("int")), "__b", "__index")
    deal = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.select(source, "source_size", F.get(deal, (F.col("__index") % len(weights)).cast("int")).alias("__weight")), "mix-sources")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    limit, level = F.col("source_size") * cap, float("-inf")
    while True:
        above = limit < F.col("__weight") * F.lit(level)
        used, left = ranked.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("__weight")))).first()
        if not left:
            break
        new = (budget - used) / left
        if new <= level:
            break
        level = new
    target = F.least(limit, F.col("__weight") * F.lit(max(level, 0.0)))
    return ranked.select(source, "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 42, range_words: int = RANGE_WORDS) -> Mixed:
    """Choose how often each row goes into a mix of ``share`` times all words.

    Each source's rows are shuffled by a hash of key and seed and queued, ``cap`` passes over; copy
    e of a row finishes at (e * source words + words queued before and in it) / target. The copies
    of all sources are range-sorted by finish time and the queue is cut at the total budget. A
    source's queue closes once it has reached its target, so what it gets differs from the target
    by less than its last document. Rows are taken whole.

    Adds size (words; null text: 0), source_size, target (double), copies (int) and taken (size *
    copies, long). Null is a source of its own, ranked last. Rows without words finish with the
    row before them. Ties in finish time: smaller source rank, hash, key. Equal rows are separate
    documents. An empty table gives no rows. Extra columns are kept, whatever their names; columns
    with the added names are replaced (mixed_rows keeps those of the input). df is read twice and
    must give the same rows in the same partitions each time, as tables do.
    """
    df = df.drop("size", "source_size", "target", "copies", "taken", "finish_times")
    # the row travels as one struct, so that no column's name clashes with those worked with here
    row = F.struct(*[f"`{c}`" for c in df.columns])
    hashed = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))
    keyed = df.select(row.alias("row"), F.col(source).alias("source"), F.col(key).alias("key"), word_count(text).alias("size"), hashed.alias("__h"), content_hash(df).alias("__t"), F.monotonically_increasing_id().alias("__i"), F.col(source).isNull().cast("int").alias("__null"))
    source, key = "source", "key"
    order = ["__null", source, "__h", key, "__t", "__i"]
    slim = materialize(keyed.select(*order, "size"), "mix-keys")
    sizes = slim.groupBy(source).agg(F.sum("size").alias("source_size"))
    goal = materialize(targets(sizes, weights, share, cap, source), "mix-targets")
    plan = plan_ranges(slim, order, "size", range_words, min_ranges=64)
    # words of all sources before one: its base in the order of the queue
    base = plan_ranges(goal.withColumn("__null", F.col(source).isNull().cast("int")), ["__null", source], "source_size", 1 << 62, min_ranges=8)
    based = base.prefix(goal.withColumn("__null", F.col(source).isNull().cast("int")), "__base", "__rank").select(F.col(source).alias("__source"), "source_size", "target", "__base", "__rank")

    def tagged(rows: DataFrame) -> DataFrame:
        rows = plan.prefix(rows, "__before", "__index").join(based, F.col(source).eqNullSafe(F.col("__source")))
        rows = rows.withColumn("__done", F.col("__before") - F.col("__base") + F.col("size"))
        finish = [F.when(F.col("target") > 0, (F.col("source_size") * e + F.col("__done")) / F.col("target")) for e in range(cap)]
        # the queue of a source is closed to copies that start at its target or later
        open_ = [F.col("source_size") * e + F.col("__done") - F.col("size") < F.col("target") for e in range(cap)]
        return rows.withColumn("__tags", F.array(*[F.when(o & (F.col("size") > 0), f) for o, f in zip(open_, finish)]))

    queue = tagged(slim).select("__rank", "__h", key, "__t", "__i", "size", F.posexplode("__tags").alias("__pass", "__finish")).filter("__finish is not null")
    queue = materialize(queue, "mix-queue")
    tie = ["__finish", "__rank", "__h", key, "__t", "__i", "__pass"]
    line = plan_ranges(queue, tie, "size", range_words, min_ranges=64)
    budget = share * (slim.agg(F.sum("size")).first()[0] or 0)
    cut = line.prefix(queue, "__sum", "__at").filter(F.col("__sum") < F.lit(budget) - F.col("size") / 2)
    last = cut.agg(F.max(F.struct(*tie)).alias("last")).first()["last"]
    rows = tagged(keyed)
    if last is None:
        copies = F.lit(0)
    else:
        types = dict(queue.dtypes)
        edge = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in tie])
        one = [F.when(F.struct(F.get("__tags", F.lit(e)).alias("__finish"), *[F.col(c).alias(c) for c in tie[1:-1]], F.lit(e).alias("__pass")) <= edge, F.get("__tags", F.lit(e)).isNotNull().cast("int")).otherwise(0) for e in range(cap)]
        copies = sum(one[1:], one[0])
    rows = rows.withColumn("copies", copies)
    return Mixed(rows.select("row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.col("__tags").alias("finish_times")), budget)


def mixed_rows(mixed: Mixed, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it was taken, with its ``finish_time``; sorting by that
    interleaves the sources in proportion to their targets."""
    df = mixed.records
    each = df.select(*[f"`{c}`" for c in columns], "copies", F.posexplode("finish_times").alias("__pass", "finish_time"))
    return each.filter(F.col("__pass") < F.col("copies")).select(*[f"`{c}`" for c in columns], "finish_time")


def digest(mixed: Mixed, key: str = "doc_id") -> DataFrame:
    return mixed.records.select(key, "size", "source_size", "target", "taken")


#: The same queue in plain SQL: ranks, water level by prefix sums, finish times, truncation.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR || '/42') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 2.0 * source_size / w, rank) AS k FROM r),
c AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM o),
b AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM s),
lev AS (SELECT (budget - used) / left_w AS level FROM c, b WHERE (budget - used) / left_w <= lim / w ORDER BY k LIMIT 1),
t AS (SELECT c.source, source_size, rank, least(lim, w * level) AS target FROM c, lev),
q AS (SELECT d.*, t.source_size, t.target, t.rank, sum(size) OVER (PARTITION BY t.rank ORDER BY h, doc_id) AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, p.e, (source_size * p.e + done)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) p(e) WHERE size > 0 AND source_size * p.e + done - size < target),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id, e) - size AS before FROM e),
n AS (SELECT doc_id, count(*) AS copies FROM z, b WHERE before < budget - size / 2 GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)
"""
