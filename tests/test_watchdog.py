"""Stalls in tables and on streams, told by timers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.streaming import watchdog

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LINES = "job string, ts timestamp, line string"


def counter():
    p = T.progress(F.col("line"))
    return F.concat_ws("/", p["done"].cast("string"), p["total"].cast("string"))


def plain(rows, limit, now):
    """One job at a time, event by event."""
    out = []
    for job in {r[0] for r in rows if r[0] is not None}:
        since, progress = None, None
        for _, s, p, ended in sorted((r for r in rows if r[0] == job and r[1] is not None), key=lambda r: (r[1], r[2] or "")):
            if not (ended or (p != progress if p is not None else progress is None)):
                continue
            if since is not None and s - since > limit:
                out.append((job, since, s, progress))
            since, progress = (None, None) if ended else (s, p if p is not None else progress)
        if since is not None and now - since > limit:
            out.append((job, since, None, progress))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [30.0, 86400.0])
def test_batch_against_plain(spark, bucket):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), r.randrange(4000), r.choice([None, None, "1", "2", "3"]), r.random() < 0.03) for _ in range(900)]
    rows = list({x[:2]: x for x in rows}.values()) + [(None, 5, "1", False), ("d", None, "1", False), ("e", 0, None, False), ("f", 0, "9", False), ("f", 3999, "9", False)]
    df = spark.createDataFrame(rows, "job string, s long, p string, e boolean").withColumn("ts", F.timestamp_seconds("s"))
    now = max(x[1] for x in rows if x[1] is not None)
    got = watchdog.stalls(df, "job", "ts", 25, F.col("p"), F.col("e"), bucket=bucket).collect()
    sec = lambda t: None if t is None else int(t.timestamp())
    assert sorted(((x.job, sec(x.since), sec(x.until), x.progress) for x in got), key=repr) == plain(rows, 25, now)
    assert all(sec(x.deadline) == sec(x.since) + 25 and x.reason == ("silent" if x.progress is None else "frozen") for x in got)
    assert watchdog.stalls(df.limit(0), "job", "ts").collect() == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, watchdog.PROVIDER)
    yield spark
    spark.conf.set(name, was)


def feed(spark, folder, name, rows):
    stamped = [(j, T0 + timedelta(seconds=s), line) for j, s, line in rows]
    spark.createDataFrame(stamped, LINES).coalesce(1).write.mode("append").json(str(folder))


def told(spark, name):
    return sorted((r.job, int((r.since.astimezone(timezone.utc) - T0).total_seconds()), r.reason, r.progress) for r in spark.table(name).collect())


def test_silent_job_is_told_without_a_further_event(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "log"
    feed(spark, folder, "1", [("dies", 0, "starting"), ("dies", 10, "1/5"), ("mute", 0, "starting"), ("fine", 0, "1/9"), ("chatty", 0, "4/7"), ("done", 5, "2/2"), ("done", 6, "exit")])
    lines = spark.readStream.schema(LINES).json(str(folder))
    progress = F.when(F.col("line").rlike("/"), counter())
    dog = watchdog.watch(lines, "job", "ts", 100, progress, F.col("line") == "exit", late="10 seconds")
    q = dog.writeStream.format("memory").queryName("dog").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert told(spark, "dog") == []
        # only the others go on; one repeats its counter
        feed(spark, folder, "2", [("fine", 90, "2/9"), ("chatty", 90, "4/7")])
        q.processAllAvailable()
        assert told(spark, "dog") == []
        feed(spark, folder, "3", [("fine", 180, "3/9"), ("chatty", 180, "4/7")])
        q.processAllAvailable()
        want = [("chatty", 0, "frozen", "4/7"), ("dies", 10, "frozen", "1/5"), ("mute", 0, "silent", None)]
        assert told(spark, "dog") == want
        # a told stall is not told again when the job goes on, a new one is
        feed(spark, folder, "4", [("chatty", 200, "5/7"), ("fine", 260, "4/9")])
        q.processAllAvailable()
        assert told(spark, "dog") == want
        feed(spark, folder, "5", [("fine", 350, "5/9"), ("chatty", 349, "6/7")])
        q.processAllAvailable()
        assert told(spark, "dog") == sorted([*want, ("chatty", 200, "frozen", "5/7")])
    finally:
        q.stop()


def test_stream_tells_what_the_table_holds(rocks, tmp_path):
    spark, folder, r = rocks, tmp_path / "log", random.Random(9)
    rows = sorted({(f"j{r.randrange(5)}", r.randrange(2000)): r.choice(["x", "1/3", "2/3", "3/3"]) for _ in range(150)}.items(), key=lambda x: x[0][1])
    rows = [(j, s, line) for (j, s), line in rows]
    for k in range(0, len(rows), 60):
        feed(spark, folder, str(k), rows[k : k + 60])
    progress = F.when(F.col("line").rlike("/"), counter())
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))
    q = watchdog.watch(lines, "job", "ts", 80, progress, late="0 seconds").writeStream.format("memory").queryName("dog2").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    table = spark.read.schema(LINES).json(str(folder))
    want = watchdog.stalls(table, "job", "ts", 80, progress).collect()
    assert told(spark, "dog2") == sorted((x.job, int((x.since.astimezone(timezone.utc) - T0).total_seconds()), x.reason, x.progress) for x in want) and want


def test_by_the_machines_clock(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "log"
    feed(spark, folder, "1", [("dies", 0, "1/5")])
    lines = spark.readStream.schema(LINES).json(str(folder))
    dog = watchdog.watch(lines, "job", "ts", 1, late=None)
    q = dog.writeStream.format("memory").queryName("dog3").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            if spark.table("dog3").count():
                break
            q.awaitTermination(1)
        assert [(r.job, r.reason) for r in spark.table("dog3").collect()] == [("dies", "silent")]
    finally:
        q.stop()
