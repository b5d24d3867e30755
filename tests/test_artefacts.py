"""The store of artefacts: insert if absent, reruns, two writers, compaction."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from inkwright.sources.artefacts import Artefacts

T = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in range(1, 10)]


def rows(spark, **kv):
    return spark.createDataFrame([(F_(k), v.encode() if v is not None else None) for k, v in kv.items()], "key string, value binary")


def F_(k):
    import hashlib

    return hashlib.sha256(k.encode()).hexdigest()


def held(store):
    return {r.key: (bytes(r.value), r.put) for r in store.read().collect()}


def test_first_put_counts_and_reruns_change_nothing(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"))
    assert store.puts() == [] and held(store) == {}
    store.put(rows(spark, a="1", b="2"), "one", T[0])
    store.put(rows(spark, b="other", c="3"), "two", T[1])
    want = {F_("a"): (b"1", "one"), F_("b"): (b"2", "one"), F_("c"): (b"3", "two")}
    assert held(store) == want
    assert store._rows(["two"]).count() == 1  # what is there is not written again
    store.put(rows(spark, b="other", c="3"), "two", T[1])
    store.put(rows(spark, a="1", b="2"), "one", T[0])
    assert held(store) == want and store._rows(store.puts()).count() == 3


def test_two_writers_at_one_time_lose_nothing(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"))
    store.put(rows(spark, z="0"), "start", T[0])
    late, early = rows(spark, a="late", b="2"), rows(spark, a="early", c="3")
    puts = store.puts
    store.puts = lambda: ["start"]  # neither sees the other
    store.put(late, "late", T[2])
    store.put(early, "early", T[1])
    store.puts = puts
    assert held(store) == {F_("z"): (b"0", "start"), F_("a"): (b"early", "early"), F_("b"): (b"2", "late"), F_("c"): (b"3", "early")}


def test_a_put_that_failed_half_way(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"))
    bad = rows(spark, a="1", b="2").withColumn("value", F.when(F.col("key") == F_("b"), F.raise_error(F.lit("lost"))).otherwise(F.col("value")).cast("binary"))
    with pytest.raises(Exception, match="lost"):
        store.put(bad, "one", T[0])
    assert held(store) == {}
    store.put(rows(spark, a="1", b="2"), "one", T[0])
    assert len(held(store)) == 2


def test_odd_rows_and_lookup(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"))
    odd = spark.createDataFrame([(None, b"x"), ("zz", b"x"), ("A1", b"x"), (F_("n"), None), (F_("t"), b"2"), (F_("t"), b"1"), (F_("t"), b"1")], "key string, value binary")
    store.put(odd, "one", T[0])
    assert held(store) == {F_("t"): (b"1", "one")}
    store.put(odd.limit(0), "none", T[1])
    asked = spark.createDataFrame([(1, F_("t")), (2, F_("t")), (3, F_("q")), (4, None)], "id int, k string")
    assert [(r.id, r.value and bytes(r.value), r.hit) for r in store.lookup(asked, "k").orderBy("id").collect()] == [(1, b"1", True), (2, b"1", True), (3, None, False), (4, None, False)]
    assert Artefacts(spark, str(tmp_path / "none")).lookup(asked, "k").filter("hit").count() == 0
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            store.put(odd, name)


def test_compaction(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"), "svg string, score double", digits=1)
    make = lambda *k: spark.createDataFrame([(F_(x), f"<svg>{x}{k[0]}</svg>", 0.5) for x in k], "key string, svg string, score double")
    for i, k in enumerate(["ab", "bc", "cde"]):
        store.put(make(*k), f"p{i}", T[i])
    before = sorted(map(tuple, store.read().drop("put").collect()))
    first, deleted = store._folder, []
    store._folder = lambda name="": (deleted.append(name), first(name))[1] if name == "" else (_ for _ in ()).throw(OSError("stopped"))
    with pytest.raises(OSError):
        store.compact("c0")  # stops before anything is deleted
    store._folder = first
    assert sorted(map(tuple, store.read().drop("put").collect())) == before and len(store.puts()) == 4
    assert store.compact("c1") == 4 and store.puts() == ["c1"]
    assert sorted(map(tuple, store.read().drop("put").collect())) == before and len(before) == 5
    store.put(make("a", "f"), "later", T[8])
    assert store.read().count() == 6 and store._rows(["later"]).count() == 1
    with pytest.raises(ValueError):
        store.compact("c1")


def test_few_keys_read_few_buckets(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "s"))
    keys = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    store.put(keys, "one", T[0])
    found = store.lookup(keys.filter("key like 'ab%'").select("key"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert found.filter("hit").count() == keys.filter("key like 'ab%'").count() > 0
