"""Event logs as streams; how to tell that a job stalls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seconds without progress after which a job counts as stalled.
STALL_S = 420
LOG = "ts timestamp, run_id string, stage string, event_type string, equation_id string, line string, payload map<string,string>"


def read_log(spark: SparkSession, path: str, stream: bool = False, schema: str = LOG) -> DataFrame:
    """JSON lines, appended by run; as a batch or as a stream of files."""
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def with_run_start(events: DataFrame, run: str = "run_id", ts: str = "ts") -> DataFrame:
    """The events, and before those of each run a record run_start."""
    starts = events.groupBy(run).agg(F.min(ts).alias(ts)).withColumn("event_type", F.lit("run_start"))
    return starts.unionByName(events, allowMissingColumns=True)


def result_json(document: str, source: str, pages: str) -> Column:
    """The record of a document's result."""
    return F.to_json(F.struct(F.col(document).cast("string").alias("document"), F.col(source).alias("source"), F.col(pages).alias("pages"), F.lit(True).alias("success")))


def cache_json(key: Column, latex: Column, score: Column, svg_length: Column) -> Column:
    """The record of a cache entry; drawings themselves stay in the cache."""
    return F.to_json(F.struct(key.alias("key"), latex.alias("latex"), score.cast("double").alias("score"), svg_length.alias("svg_length")))


def event_windows(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """window_start, kind, n, total per tumbling window; the same plan for batches and streams."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", late) if late and events.isStreaming else rows
    got = rows.groupBy(F.window("__ts", width).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def stall_gaps(events: DataFrame, key: str, ts: str, seconds: float, order: list[str] | None = None) -> DataFrame:
    """Batch form: key, since, until, gap_s wherever nothing came for more than ``seconds``."""
    w = W.partitionBy(key).orderBy(ts, *(order or []))
    rows = events.select(key, F.lag(ts).over(w).alias("since"), F.col(ts).alias("until"))
    gap = F.unix_micros(F.col("until").cast("timestamp")) / 1e6 - F.unix_micros(F.col("since").cast("timestamp")) / 1e6
    return rows.withColumn("gap_s", gap).filter(F.col("gap_s") > seconds)


def advances(progress: Column, before: Column, any_before: Column) -> Column:
    """Whether a line counts as progress: either number of done/total changed; before the first
    counter, any line does."""
    return F.when(progress.isNotNull(), ~progress.eqNullSafe(before)).otherwise(~any_before)


def stall_stream(events: DataFrame, key: str, ts: str, seconds: float = STALL_S) -> DataFrame:
    """Streaming form: the state keeps each key's last event; a later one after more than
    ``seconds`` emits key, since, until, gap_s."""
    kind = dict(events.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["us"])
        out = []
        for t in map(int, times):
            if last is not None and t - last > seconds * 1e6:
                out.append((k[0], pd.Timestamp(last, unit="us"), pd.Timestamp(t, unit="us"), (t - last) / 1e6))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "since", "until", "gap_s"])

    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, since timestamp, until timestamp, gap_s double", "last bigint", "append", "NoTimeout")
