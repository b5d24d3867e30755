"""Runs that tell of themselves while they go on: a log of records, metrics of each stage, a result record.

Metrics are observed on the rows that a stage writes anyway, so counting takes no job of its own.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from .logs import read_log

# The counts of a result record, in its order.
COUNTS = ("total_equations", "equations_passed", "equations_repaired", "equations_fallback", "equations_flagged", "cache_hits", "cache_misses")
_STAGE = "struct<stage_name:string, ok:boolean, duration_ms:double, warnings:array<string>, errors:array<string>, metrics:map<string,string>>"
RESULT = f"document_path string, started_at string, finished_at string, ok boolean, output_epub_path string, {', '.join(f'{c} bigint' for c in COUNTS)}, fatal_error string, stage_results array<{_STAGE}>"
#: Seconds to wait for the metrics of an action that has ended; they come by the listener bus.
PATIENCE_S = 30.0


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Stage:
    """A stage of a run, as its block sees it: watch() rows, warn(), or set metrics known otherwise."""

    def __init__(self, name: str):
        self.name, self.metrics, self.warnings, self.errors = name, {}, [], []
        self.ok, self.duration_ms = True, 0.0
        self._watched: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """df, whose first action also works out ``metrics``, aggregates over its rows.

        Write or collect it as it is, within the stage's block. A limit above it leaves metrics short, and
        what is made of it first (say, a join that finds nothing) may be planned away with its metrics;
        metrics that don't come are told by a warning."""
        seen = Observation(f"{self.name}-{uuid.uuid4().hex}")
        self._watched.append((seen, list(metrics)))
        return df.observe(seen, *[c.alias(n) for n, c in metrics.items()])

    def warn(self, text: str) -> None:
        self.warnings.append(text)

    def _collect(self, patience: float) -> None:
        until = time.monotonic() + patience
        for seen, names in self._watched:
            done = seen._jo.future().isCompleted
            while not done() and time.monotonic() < until:
                time.sleep(0.02)
            if done() and seen._jo.getRow().length():
                self.metrics |= seen.get
            else:
                self.warn(f"not observed: {', '.join(names)}")

    def record(self) -> dict:
        return {"stage_name": self.name, "ok": self.ok, "duration_ms": self.duration_ms, "warnings": self.warnings, "errors": self.errors, "metrics": self.metrics}


class Run:
    """A run over one document or table, used as a context; its records go below ``folder``.

    Each record is a file of one JSON line, written as it happens: run_start, stage_start, stage_end or
    stage_end_error, run_end. On leaving, whether in order or by an exception, the result record
    follows. Counts of the result are the stages' metrics of the same names, the last of each.
    """

    def __init__(self, spark: SparkSession, document: str, folder: str, run_id: str | None = None, **facts: object):
        self.spark, self.document, self.folder = spark, document, folder.rstrip("/")
        self.run_id, self.facts = run_id or uuid.uuid4().hex[:12], facts
        self.output: str | None = None
        self.stages: list[Stage] = []
        self.started_at, self.finished_at, self.fatal_error, self._n = None, None, None, 0

    def _write(self, name: str, record: dict) -> None:
        """One file, put aside and renamed, so that a reader never sees half of it."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        path, aside = hadoop(f"{self.folder}/{name}"), hadoop(f"{self.folder}/_{uuid.uuid4().hex}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(aside, True)
        try:
            out.write(bytearray((json.dumps(record, default=str, ensure_ascii=False) + "\n").encode()))
        finally:
            out.close()
        fs.mkdirs(path.getParent())
        if not fs.rename(aside, path):
            raise OSError(f"could not write {path}")

    def tell(self, kind: str, stage: str | None = None, line: str | None = None, equation_id: str | None = None, **payload: object) -> None:
        """Write one record to the log."""
        self._n += 1
        shown = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in payload.items()}
        self._write(f"log/{self.run_id}-{self._n:06d}.json", {"ts": _now(), "run_id": self.run_id, "stage": stage, "event_type": kind, "equation_id": equation_id, "line": line, "payload": shown})

    def __enter__(self) -> Run:
        self.started_at = _now()
        context = self.spark.sparkContext
        self.tell("run_start", document=self.document, application=context.applicationId, spark=context.version, **self.facts)
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.finished_at = _now()
        if error is not None:
            self.fatal_error = f"{kind.__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        self.tell("run_end", ok=self.ok, fatal_error=self.fatal_error)
        self._write(f"results/{self.run_id}.json", self.result())

    @contextmanager
    def stage(self, name: str, **facts: object) -> Iterator[Stage]:
        """A stage; an exception in it is recorded as its error and goes on."""
        now = Stage(name)
        self.stages.append(now)
        self.tell("stage_start", name, **facts)
        began, patience = time.perf_counter(), PATIENCE_S
        try:
            yield now
        except Exception as e:
            now.ok, patience = False, 0.0
            now.errors.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            raise
        finally:
            now._collect(patience)
            now.duration_ms = round((time.perf_counter() - began) * 1000, 2)
            self.tell("stage_end" if now.ok else "stage_end_error", name, duration_ms=now.duration_ms, errors=now.errors, warnings=now.warnings, **{f"metric.{k}": v for k, v in now.metrics.items()})

    @property
    def ok(self) -> bool:
        return self.fatal_error is None and all(s.ok for s in self.stages)

    def result(self) -> dict:
        """The result record, complete once the run is left."""
        counts = {c: next((s.metrics[c] for s in reversed(self.stages) if c in s.metrics), 0) for c in COUNTS}
        return {"document_path": self.document, "started_at": self.started_at, "finished_at": self.finished_at, "ok": self.ok, "output_epub_path": self.output, **counts, "fatal_error": self.fatal_error, "stage_results": [s.record() for s in self.stages]}


class StreamLog(StreamingQueryListener):
    """Tells a run of its streaming queries: stage_start, a progress record for each batch with its rows and
    the metrics observed on it, and how the query ended. Add it by spark.streams.addListener."""

    def __init__(self, run: Run):
        self.run, self.names = run, {}

    def _name(self, query) -> str:
        return self.names.get(str(query), str(query))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.run.tell("stage_start", self._name(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"metric.{k}": v for m, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        self.run.tell("progress", self._name(p.id), batch=p.batchId, rows=p.numInputRows, **seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        errors = [event.exception.splitlines()[0]] if event.exception else []
        self.run.tell("stage_end_error" if errors else "stage_end", self._name(event.id), errors=errors)


def read_runs(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The log records of all runs below ``folder``, as a batch or as a stream that sees them come."""
    return read_log(spark, f"{folder.rstrip('/')}/log", stream)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """The result records of all runs below ``folder``, one row a run."""
    return spark.read.schema(RESULT).json(f"{folder.rstrip('/')}/results")
