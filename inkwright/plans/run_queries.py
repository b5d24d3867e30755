"""Queries on runs: stalls, and what a run leaves behind."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import text as T
from ..operators import relational as R
from ..sources import parsed_pages
from ..sources.artefacts import Artefacts
from ..sources.shared import shared_folder
from ..streaming import runs, watchdog
from .latex_queries import _score_sql
from .table_queries import _SPAN_ROWS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_stalls(spark, sf_dir):
    """Users as jobs: the counter is the property k, which views don't show; a signup closes a run."""
    counter = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k"))
    return watchdog.stalls(_table(spark, sf_dir, "events"), "user_id", "ts", 43200.0, counter, F.col("event_type") == "signup", order=["event_id"])


def preferred_parses(spark, sf_dir):
    """The parse to read of each document (here: market segment and nation), named after it or not."""
    c = _table(spark, sf_dir, "customer")
    document = F.concat("c_mktsegment", F.lit("_"), "c_nationkey")
    name = F.when(F.col("c_acctbal") > 8000, document).when(F.col("c_acctbal") > 0, F.col("c_name"))
    path = F.concat(F.lit("p/"), F.col("c_name"), F.lit("/"), F.coalesce(F.concat(name, F.lit("_middle.json")), F.lit("other.json")))
    return parsed_pages.preferred_each(c.select(document.alias("document"), path.alias("path")))


#: Groups of sources with a run each.
LIBRARIES = 4
#: When the first run's artefacts are stored; each run stores a day later.
FIRST = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[str, Artefacts]:
    """A run for each of LIBRARIES groups of sources, in order: its formulas are judged, then looked up
    in a store that all runs share, and those it lacks are put there."""
    folder = shared_folder(spark, "runs")
    store = Artefacts(spark, f"{folder}/store", "latex string, score double", digits=1)
    library = F.concat(F.lit("library_"), F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0)) % LIBRARIES)
    docs = _table(spark, sf_dir, "documents").withColumn("library", library)
    found = docs.select("library", F.explode(T.delimiters(F.col("text"))).alias("span"))
    kind = F.when(T.is_display(F.col("span")), "display").otherwise("inline")
    rows = found.select("library", kind.alias("formula_class"), T.inside(F.col("span")).alias("latex"))
    rows = rows.withColumn("key", F.sha2(F.concat("formula_class", F.lit("|"), "latex"), 256))
    for day in range(LIBRARIES):
        with runs.Run(spark, f"library_{day}", folder, run_id=f"run-{day}") as run:
            judged = f"{folder}/judged/{run.run_id}"
            with run.stage("validate") as stage:
                score = F.round(L.plausibility(F.col("latex"), F.lit(False)), 6)
                own = rows.filter(F.col("library") == run.document).withColumn("score", score)
                stage.watch(own, total_equations=F.count("*"), equations_passed=F.count_if(F.col("score") >= 0.65), equations_fallback=F.count_if(F.col("score") < 0.4)).write.parquet(judged)
            with run.stage("cache") as stage:
                asked = spark.read.schema("library string, formula_class string, latex string, key string, score double").parquet(judged)
                seen = store.lookup(asked.select("key", F.col("latex").alias("own_latex"), F.col("score").alias("own_score")))
                stage.watch(seen, cache_hits=F.count_if("hit"), cache_misses=F.count_if(~F.col("hit"))).write.parquet(f"{judged}-seen")
                missed = spark.read.schema(seen.schema).parquet(f"{judged}-seen").filter("not hit")
                store.put(missed.select("key", F.col("own_latex").alias("latex"), F.col("own_score").alias("score")), run.run_id, FIRST + timedelta(days=day))
    return folder, store


def library_runs(spark, sf_dir):
    """The result records of the runs, as they were written."""
    folder, _ = _runs(spark, sf_dir)
    done = runs.read_results(spark, folder)
    stages = F.array_join(F.transform("stage_results", lambda s: F.concat(s["stage_name"], F.when(s["ok"], ":ok").otherwise(":error"))), ",")
    return done.select("document_path", "ok", "total_equations", "equations_passed", "equations_repaired", "equations_fallback", "cache_hits", "cache_misses", R.hit_rate(F.col("cache_hits"), F.col("cache_misses")).alias("hit_rate"), stages.alias("stages"), "fatal_error")


def library_artefacts(spark, sf_dir):
    """What the store holds after all runs, compacted: each formula once, from the run that met it first."""
    _, store = _runs(spark, sf_dir)
    store.compact("all")
    return store.read().select("key", "latex", "score", F.datediff("stored_at", F.lit(FIRST)).alias("run"))


QUERIES = {f.__name__: f for f in (open_stalls, preferred_parses, library_runs, library_artefacts)}
_BY_RUN = f"(SELECT coalesce(try_cast(regexp_extract(source, '(\\d+)', 1) AS INT), 0) % {LIBRARIES} AS run, latex, sha256(formula_class || '|' || latex) AS key, round({_score_sql('latex', 'false')}, 6) AS score FROM {_SPAN_ROWS} JOIN documents USING (doc_id))"
ORACLES = {
    "open_stalls": """
WITH e AS (SELECT user_id, ts, event_id, event_type = 'signup' AS ended, CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS progress FROM events),
r AS (SELECT *, count(*) FILTER (WHERE ended) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM e),
b AS (SELECT *, last_value(progress IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
t AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM b WHERE ended OR CASE WHEN progress IS NULL THEN before IS NULL ELSE progress IS DISTINCT FROM before END)
SELECT user_id, ts AS since, ts + INTERVAL 43200 SECOND AS deadline, until, CASE WHEN coalesce(progress, before) IS NULL THEN 'silent' ELSE 'frozen' END AS reason, coalesce(progress, before) AS progress
FROM t, (SELECT max(ts) AS now FROM events) WHERE NOT ended AND epoch_us(coalesce(until, now)) - epoch_us(ts) > 43200000000""",
    "preferred_parses": """
WITH f AS (SELECT c_mktsegment || '_' || c_nationkey AS document, CASE WHEN c_acctbal > 8000 THEN 0 ELSE 1 END::INT AS preference, 'p/' || c_name || '/' || CASE WHEN c_acctbal > 8000 THEN c_mktsegment || '_' || c_nationkey ELSE c_name END || '_middle.json' AS path FROM customer WHERE c_acctbal > 0)
SELECT document, path, preference FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY preference, path) AS r FROM f) WHERE r = 1""",
    "library_runs": f"""
WITH s AS (SELECT *, run > min(run) OVER (PARTITION BY key) AS hit FROM {_BY_RUN}),
c AS (SELECT run, count(*) AS total_equations, count(*) FILTER (score >= 0.65) AS equations_passed, count(*) FILTER (score < 0.4) AS equations_fallback, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses FROM s GROUP BY run)
SELECT 'library_' || l.run AS document_path, true AS ok, coalesce(total_equations, 0) AS total_equations, coalesce(equations_passed, 0) AS equations_passed, 0::BIGINT AS equations_repaired, coalesce(equations_fallback, 0) AS equations_fallback, coalesce(cache_hits, 0) AS cache_hits, coalesce(cache_misses, 0) AS cache_misses,
 coalesce(round(cache_hits / nullif(cache_hits + cache_misses, 0), 4), 0)::DOUBLE AS hit_rate, 'validate:ok,cache:ok' AS stages, NULL::VARCHAR AS fatal_error FROM (SELECT unnest(range({LIBRARIES})) AS run) l LEFT JOIN c ON l.run = c.run""",
    "library_artefacts": f"SELECT key, any_value(latex) AS latex, any_value(score) AS score, min(run)::INT AS run FROM {_BY_RUN} GROUP BY key",
}
