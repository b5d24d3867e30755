"""Ranges, sharding and mixing against plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkwright.llm import mixing, ranges, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def corpus(n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["ab", "cde", "é", "longer-word"]) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \n\t ", None), (None, "null id", "c"), (5, "same id", "a"), (7, rows[7][1], rows[7][2]), (n + 3, "word " * 3000, "d")]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_prefix_sums_follow_the_order(spark, hot):
    r = random.Random(3)
    rows = [(1 if hot else r.randint(0, 40), i, r.randint(0, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, w long")
    plan = ranges.plan_ranges(df, ["k", "i"], "w", 500, min_ranges=16)
    got = {(x.k, x.i): (x.before, x.at) for x in plan.prefix(df, "before", "at").collect()}
    total = 0
    for at, (k, i, w) in enumerate(sorted(rows)):
        assert got[k, i] == (total, at)
        total += w
    assert len(plan.rows) >= 16 and max(plan.rows) < 900


def test_prefix_sums_of_nothing(spark):
    df = spark.createDataFrame([], "k int, w long")
    plan = ranges.plan_ranges(df, ["k"], "w", 500)
    assert plan.prefix(df, "b", "a").count() == 0


def test_shards_are_even_and_gapless(spark):
    rows = corpus()
    df = docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("extra", F.lit(1))
    found = sharding.shard(df, n_shards=24)
    assert found.records.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "size", "shard", "slot"]
    got = sharding.digest(found).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size, x.text_crc32) for x in got) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    # the same law in plain Python, up to the order of rows with one id
    total, before, sums = sum(size(t) for _, t, _ in rows), 0, {}
    for x in got:
        sums[x.shard] = sums.get(x.shard, 0) + x.size
    for s in set(range(24)):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    longest = max(size(t) for _, t, _ in rows)
    assert all(abs(v - total / 24) <= longest for v in sums.values())
    seen = sorted((x.shard, x.slot, -1 if x.doc_id is None else x.doc_id) for x in got)
    assert [d for _, _, d in seen] == sorted(d for _, _, d in seen)
    assert not before


def test_shards_of_equal_rows_and_of_none(spark):
    df = docs(spark, [(1, "same", "a")] * 240)
    got = sharding.digest(sharding.shard(df, n_shards=24)).groupBy("shard").count().collect()
    assert sorted(x["count"] for x in got) == [10] * 24
    assert sharding.digest(sharding.shard(docs(spark, []))).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    found = sharding.shard(docs(spark, corpus(60)), n_shards=4)
    sharding.write_shards(found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 67 and {x.shard for x in back.select("shard").distinct().collect()} <= {0, 1, 2, 3}


def words(t):
    return len((t or "").encode().split())


def fill(sizes):
    """Targets by definition: deal what is left by weight until nobody is above twice their size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (left - sum(fixed.values())) * weight[s] / sum(weight[t] for t in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in above}


def test_mix_meets_targets(spark):
    rows = corpus(400, 5)
    df = docs(spark, rows).withColumn("size", F.lit("clash"))
    mixed = mixing.mix(df)
    got = mixing.digest(mixed).collect()
    again = mixing.digest(mixing.mix(df)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = fill(sizes)
    by_source = mixed.records.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).collect()
    for x in by_source:
        longest = max(words(t) for _, t, s in rows if s == x.source)
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source])
        assert abs(x.taken - x.target) <= longest
    assert all(x.taken <= 2 * x.size and x.taken % max(1, x.size) == 0 for x in got)
    assert sorted(map(key, got))[0][0] is False
    out = mixing.mixed_rows(mixed, df.columns)
    assert out.count() == mixed.records.agg(F.sum("copies")).first()[0]


def test_mix_of_nothing_and_of_blank_texts(spark):
    assert mixing.digest(mixing.mix(docs(spark, []))).count() == 0
    got = mixing.digest(mixing.mix(docs(spark, [(1, None, "a"), (2, "  ", None)]))).collect()
    assert {(x.size, x.taken) for x in got} == {(0, 0)}
