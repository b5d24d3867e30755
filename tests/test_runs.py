"""Runs: records while they go on, observed metrics, result records, streams."""

import time

import pytest
from pyspark.sql import functions as F

from inkwright.streaming import runs
from inkwright.streaming.runs import Run, StreamLog, read_results, read_runs


def kinds(spark, folder, run):
    return [(r.event_type, r.stage) for r in read_runs(spark, folder).filter(F.col("run_id") == run.run_id).orderBy("ts").collect()]


def test_result_of_a_run(spark, tmp_path):
    folder = str(tmp_path)
    with Run(spark, "book.pdf", folder, seed=7) as run:
        with run.stage("validate") as s:
            rows = s.watch(spark.range(100), total_equations=F.count("*"), equations_passed=F.count_if(F.col("id") < 60))
            rows.write.parquet(str(tmp_path / "rows"))
        assert kinds(spark, folder, run) == [("run_start", None), ("stage_start", "validate"), ("stage_end", "validate")]  # in flight
        with run.stage("store") as s:
            s.watch(spark.range(10).repartition(3), cache_hits=F.count_if(F.col("id") % 2 == 0), cache_misses=F.count_if(F.col("id") % 2 == 1)).write.format("noop").mode("overwrite").save()
            s.warn("small")
            s.metrics["other"] = "x"
        run.output = "book.epub"
    r = read_results(spark, folder).collect()[0]
    assert len(r.asDict()) == 14
    assert (r.document_path, r.ok, r.output_epub_path, r.fatal_error) == ("book.pdf", True, "book.epub", None)
    assert tuple(r[c] for c in runs.COUNTS) == (100, 60, 0, 0, 0, 5, 5)
    assert [(s.stage_name, s.ok, s.warnings, s.errors, s.metrics) for s in r.stage_results] == [
        ("validate", True, [], [], {"total_equations": "100", "equations_passed": "60"}), ("store", True, ["small"], [], {"cache_hits": "5", "cache_misses": "5", "other": "x"})]
    assert all(s.duration_ms > 0 for s in r.stage_results) and r.started_at < r.finished_at
    start = read_runs(spark, folder).filter("event_type = 'run_start'").collect()[0].payload
    assert start["document"] == "book.pdf" and start["seed"] == "7" and start["application"] == spark.sparkContext.applicationId
    assert not list(tmp_path.glob("_*"))


def test_a_run_that_fails(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        with Run(spark, "b", str(tmp_path)) as run:
            with run.stage("one") as s:
                s.watch(spark.range(5), total_equations=F.count("*")).collect()
            with run.stage("two") as s:
                s.watch(spark.range(5).select(F.raise_error(F.lit("broken")).alias("x")), cache_hits=F.count("*")).collect()
    r = read_results(spark, str(tmp_path)).collect()[0]
    assert not r.ok and "broken" in r.stage_results[1].errors[0] + r.fatal_error and r.total_equations == 5
    assert [s.ok for s in r.stage_results] == [True, False]
    assert kinds(spark, str(tmp_path), run)[-2:] == [("stage_end_error", "two"), ("run_end", None)]


def test_a_stage_without_an_action_says_so(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PATIENCE_S", 0.2)
    with Run(spark, "b", str(tmp_path)) as run:
        with run.stage("idle") as s:
            s.watch(spark.range(5), total_equations=F.count("*"))
    assert run.stages[0].warnings == ["not observed: total_equations"] and run.result()["total_equations"] == 0


def test_metrics_that_were_planned_away_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "PATIENCE_S", 2.0)
    with Run(spark, "b", str(tmp_path)) as run:
        with run.stage("gone") as s:
            rows = s.watch(spark.range(20), total_equations=F.count("*")).filter("id > 50").distinct()
            assert rows.join(spark.range(5), "id").collect() == []
    assert run.stages[0].metrics or run.stages[0].warnings == ["not observed: total_equations"]


def test_an_empty_table(spark, tmp_path):
    with Run(spark, "é", str(tmp_path)) as run:
        with run.stage("none") as s:
            s.watch(spark.range(0), total_equations=F.count("*"), most=F.max("id")).collect()
    assert run.stages[0].metrics == {"total_equations": 0, "most": None}
    assert read_results(spark, str(tmp_path)).collect()[0].document_path == "é"


def test_streams_tell_their_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    spark.range(30).repartition(1).write.parquet(source)
    run = Run(spark, "s", folder)
    log = StreamLog(run)
    spark.streams.addListener(log)
    try:
        with run:
            rows = spark.readStream.schema("id bigint").parquet(source).observe("seen", F.count("*").alias("total"), F.max("id").alias("most"))
            query = rows.writeStream.format("noop").queryName("numbers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
            until = time.monotonic() + 30
            while time.monotonic() < until and "stage_end" not in [k for k, _ in kinds(spark, folder, run)]:
                time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    got = read_runs(spark, folder).filter("event_type = 'progress'").collect()
    assert [(r.stage, r.payload["rows"], r.payload["metric.total"], r.payload["metric.most"]) for r in got] == [("numbers", "30", "30", "29")]
    assert kinds(spark, folder, run)[-1] == ("run_end", None)
