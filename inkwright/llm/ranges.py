"""Sampled splitters: cut an ordered table into ranges of near equal weight, and sum along the order.

The plan has one row per range on the driver; ranges follow the data only through ``range_weight``,
so 100 TB in ranges of 256 MB are 400,000 numbers. No row-sized data are collected but the key
sample, whose expected size is ``oversample`` keys for each range.
"""

from __future__ import annotations

import bisect
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sort_key(row: tuple) -> tuple:
    """Spark's order for the keys used here: nulls first, strings by code point."""
    return tuple((0, 0) if v is None else (1, v) for v in row)


@dataclass
class RangePlan:
    """Splitters over ``keys``; range i holds the keys from splitter i-1 (inclusive) up to splitter i."""

    keys: list[str]
    types: list[str]
    weight: str
    bounds: list[tuple] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(self.weights)

    def range_id(self) -> Column:
        """Binary search of the row's key among the splitters, on the JVM."""
        if not self.bounds:
            return F.lit(0)
        kind = ",".join(f"k{i}:{t}" for i, t in enumerate(self.types))
        split = F.from_json(F.lit(json.dumps([{f"k{i}": v for i, v in enumerate(b)} for b in self.bounds])), f"array<struct<{kind}>>")
        key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])
        n = len(self.bounds)

        def step(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            here = F.get(split, mid)
            return F.when(a["lo"] >= a["hi"], a).when(here <= key, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

        first = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(n + 1)) + 1)), first, step, lambda a: a["lo"])

    def _before(self, values: list[int], rid: Column) -> Column:
        sums = [0]
        for v in values[:-1]:
            sums.append(sums[-1] + v)
        return F.get(F.from_json(F.lit(json.dumps(sums)), "array<bigint>"), rid)

    def prefix(self, df: DataFrame, before: str, index: str, rid: str = "__rid") -> DataFrame:
        """Add, for the order of the keys, the weight before each row and its index from 0.

        One exchange by range id: a hot key is spread over ranges by the later keys.
        """
        w = W.partitionBy(rid).orderBy(*self.keys)
        df = df.withColumn(rid, self.range_id())
        up_to = F.sum(self.weight).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        df = df.withColumn(before, up_to - F.col(self.weight)).withColumn(index, F.row_number().over(w).cast("long") - 1)
        return df.withColumn(before, F.col(before) + self._before(self.weights, F.col(rid))).withColumn(index, F.col(index) + self._before(self.rows, F.col(rid)))


def plan_ranges(df: DataFrame, keys: list[str], weight: str, range_weight: int, min_ranges: int = 64, oversample: int = 12, seed: int = 42, max_rounds: int = 12) -> RangePlan:
    """Draw a size-weighted sample of keys, take its quantiles as splitters, count each range
    exactly, and subdivide overfull ranges with further samples until none can be split.

    keys: columns that together tell rows apart (the last ones break ties); a range whose rows
    share all keys stays whole. weight: a long column, 0 or more. The sample depends on nothing
    but the keys, so reruns agree. An empty table gives one empty range.
    """
    kinds = dict(df.dtypes)
    plan = RangePlan(keys, [kinds[k] for k in keys], weight)
    slim = df.select(*keys, (F.col(weight) + 1).alias("__w"), F.col(weight).alias("__v"))
    total, n = slim.agg(F.sum("__w"), F.count("*")).first()
    if not n:
        plan.weights, plan.rows = [0], [0]
        return plan
    target = max(1, min(math.ceil(total / min_ranges), range_weight))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(2**53))
    hot: list[int] | None = None
    for round_ in range(max_rounds):
        rate = oversample / target * (4**round_ if hot is not None else 1)
        sample = slim if hot is None else slim.withColumn("__r", plan.range_id()).filter(F.col("__r").isin(hot))
        drawn = sample.filter(unit < F.col("__w") * rate).select(*keys, "__w").collect()
        points = sorted(((_sort_key(r[:-1]), tuple(r[:-1]), max(r[-1], 1 / rate)) for r in drawn), key=lambda x: x[0])
        bounds, old = [], [_sort_key(b) for b in plan.bounds]
        held, at = 0.0, None
        for order, key, w in points:
            now = bisect.bisect_right(old, order)
            if now != at:
                held, at = 0.0, now
            if held and held + w > target and (not bounds or bounds[-1] != key):
                bounds.append(key)
                held = 0.0
            held += w
        merged = {_sort_key(b): b for b in [*plan.bounds, *bounds]}
        grew = len(merged) > len(plan.bounds)
        plan.bounds = [merged[k] for k in sorted(merged)]
        counts = {r[0]: r[1:] for r in slim.groupBy(plan.range_id().alias("__r")).agg(F.sum("__v"), F.count("*"), F.sum("__w"), F.max("__w")).collect()}
        full = [counts.get(i, (0, 0, 0, 0)) for i in range(len(plan.bounds) + 1)]
        plan.weights, plan.rows = [c[0] for c in full], [c[1] for c in full]
        hot = [i for i, c in enumerate(full) if c[1] > 1 and c[2] > 3 * target and c[2] > 1.5 * c[3]]
        if not hot or (round_ and not grew):
            break
    return plan
