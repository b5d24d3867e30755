"""A watchdog over jobs' events: a job whose progress stands still is told, though nothing more comes from it.

A job's clock is its last output until it shows a first progress counter, and the last change of
that counter from then on: lines that repeat a counter don't move it. When the clock stands for
more than ``seconds``, that is one stall. An event with ``ended`` true closes the job's watch: what
comes after it is a new run without a counter.

``stalls`` finds them in a table, those still open at its end included; ``watch`` tells them on a
stream by timers. Both return key, since (where the clock stands), deadline (since + seconds),
reason ("frozen" with a counter, else "silent") and progress (the counter, null if silent).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .logs import STALL_S, advances

#: The state store that keeps timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FROZEN, SILENT = "frozen", "silent"


def _slim(events: DataFrame, key: str, ts: str, progress: Column | None, ended: Column | None, order: list[str] | None = None) -> DataFrame:
    none, no = F.lit(None).cast("string"), F.lit(False)
    ties = [F.col(c).alias(f"tie{i}") for i, c in enumerate(order or [])]
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), (none if progress is None else progress.cast("string")).alias("progress"), (no if ended is None else F.coalesce(ended, no)).alias("ended"), *ties)
    return rows.filter("key is not null and ts is not null")


def stalls(events: DataFrame, key: str, ts: str, seconds: float = STALL_S, progress: Column | None = None, ended: Column | None = None, now: Column | None = None, order: list[str] | None = None, bucket: float = 86400.0) -> DataFrame:
    """Batch form: key, since, deadline, until, reason, progress of every stall.

    until is the event that moved the clock again or closed the watch; null where none has by
    ``now`` (default: the last time in the table). Rows without a time or key play no part. Rows of
    one time are taken by ``order``, then as counters ascend. An empty table gives no rows.

    A key's events are cut into buckets of ``bucket`` seconds, which are worked on apart: only one
    row a bucket meets the key's others, so that a job with a third of all events is many tasks.
    """
    rows = _slim(events, key, ts, progress, ended, order).withColumn("bucket", F.floor(F.unix_micros("ts") / int(bucket * 1_000_000)))
    at = ["ts", *[f"tie{i}" for i in range(len(order or []))], "progress"]
    inside = W.partitionBy("key", "bucket").orderBy(*at)
    buckets = W.partitionBy("key").orderBy("bucket")
    # the counter that holds after a row that sets one, or that unsets it as it closes the watch
    held = F.when(F.col("ended"), F.struct(F.lit(None).cast("string").alias("p"))).when(F.col("progress").isNotNull(), F.struct(F.col("progress").alias("p")))
    rows = rows.withColumn("held", held)
    # what a bucket begins with: what the last such row before it left
    last = rows.groupBy("key", "bucket").agg(F.max_by("held", F.when(F.col("held").isNotNull(), F.struct(*at))).alias("last"))
    carried = last.withColumn("carried", F.last("last", True).over(buckets.rowsBetween(W.unboundedPreceding, -1))).drop("last")
    rows = rows.join(carried, ["key", "bucket"])
    before = F.coalesce(F.last("held", True).over(inside.rowsBetween(W.unboundedPreceding, -1)), "carried")
    rows = rows.withColumn("before", before["p"]).withColumn("shown", F.coalesce("progress", "before"))
    ticks = rows.filter(F.col("ended") | advances(F.col("progress"), F.col("before"), F.col("before").isNotNull()))
    # the next tick stands in the same bucket, or is the first of a later one
    first = ticks.groupBy("key", "bucket").agg(F.min("ts").alias("first"))
    later = first.withColumn("later", F.lead("first").over(buckets)).drop("first")
    ticks = ticks.withColumn("until", F.lead("ts").over(inside)).join(later, ["key", "bucket"]).withColumn("until", F.coalesce("until", "later"))
    if now is None:
        ticks = ticks.crossJoin(events.agg(F.max(F.col(ts).cast("timestamp")).alias("now")))  # a single row
    else:
        ticks = ticks.withColumn("now", now)
    stood = F.unix_micros(F.coalesce("until", "now")) - F.unix_micros("ts")
    limit = int(seconds * 1_000_000)
    found = ticks.filter(~F.col("ended") & (stood > limit))
    deadline = F.timestamp_micros(F.unix_micros("ts") + limit)
    return found.select(F.col("key").alias(key), F.col("ts").alias("since"), deadline.alias("deadline"), "until", F.when(F.col("shown").isNull(), SILENT).otherwise(FROZEN).alias("reason"), F.col("shown").alias("progress"))


class Watchdog(StatefulProcessor):
    """State of a job: where its clock stands (microseconds), its counter, whether that stall was told.

    One timer stands at the deadline; when it has told a stall, a second one forgets the job after
    ``forget`` seconds. In processing time, the clock is the time at which events are read.
    """

    def __init__(self, seconds: float, forget: float, processing: bool):
        self.limit, self.forget, self.processing = int(seconds * 1_000_000), int(forget * 1000), processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "since bigint, progress string, told boolean")

    def _timer(self, at_ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def _row(self, key: tuple, since: int, progress: str | None) -> dict:
        stamp = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
        return {"key": key[0], "since": stamp(since), "deadline": stamp(since + self.limit), "reason": SILENT if progress is None else FROZEN, "progress": progress}

    def _out(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "since", "deadline", "reason", "progress"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        since, progress, told = self.clock.get() if self.clock.exists() else (None, None, False)
        read_at, found = timerValues.getCurrentProcessingTimeInMs() * 1000, []
        came = [x for f in rows for x in zip(f["us"].tolist(), f["progress"].where(f["progress"].notna(), None).tolist(), f["ended"].tolist())]
        for us, p, ended in sorted(came, key=lambda x: (x[0], x[1] or "")):
            us, counts = read_at if self.processing else us, p is not None
            if not (ended or (p != progress if counts else progress is None)):
                continue
            if since is not None and not told and us - since > self.limit:
                found.append(self._row(key, since, progress))
            told = False
            if ended:
                since, progress = None, None
            else:
                since, progress = us if since is None else max(since, us), p if counts else progress
        if since is None:
            self.clock.clear()
            self._timer(None)
        else:
            self.clock.update((since, progress, told))
            if not told:
                self._timer(-(-(since + self.limit + 1) // 1000))
        yield self._out(found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        since, progress, told = self.clock.get()
        if told:
            self.clock.clear()
            return
        self.clock.update((since, progress, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.forget)
        yield self._out([self._row(key, since, progress)])

    def close(self) -> None:
        pass


def watch(events: DataFrame, key: str, ts: str, seconds: float = STALL_S, progress: Column | None = None, ended: Column | None = None, late: str | None = "10 minutes", forget: float = 86400.0) -> DataFrame:
    """Streaming form: key, since, deadline, reason, progress, one row a stall, as soon as it is certain.

    With ``late``, in event time: a stall is told when the watermark (the latest time of any job
    less ``late``) passes its deadline, with no further event of its job; later events that come
    out of order across batches don't move the clock back. Without, in processing time, by the
    machine's clock. A job is forgotten ``forget`` seconds after a told stall. Needs the state store
    provider PROVIDER; state is a row a job that is alive, and survives lost executors.
    """
    kind = dict(events.dtypes)[key]
    rows = _slim(events, key, ts, progress, ended)
    if late:
        rows = rows.withWatermark("ts", late)
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("us"), "progress", "ended")
    dog = Watchdog(seconds, forget, processing=not late)
    out = rows.groupBy("key").transformWithStateInPandas(dog, f"key {kind}, since timestamp, deadline timestamp, reason string, progress string", "append", "EventTime" if late else "ProcessingTime")
    return out.withColumnRenamed("key", key)
