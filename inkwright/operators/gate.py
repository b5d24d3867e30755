"""Confidence gates, repair, routing: one CASE after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions.strings import count_of, let

# Thresholds, ranks, smallest image.
PASS_AT, REPAIR_AT = 0.65, 0.40
RANKS = ("pass", "repair", "fallback", "flagged")
MIN_CROP = (20, 10)


def proxy_compiles(x: Column) -> Column:
    """Stands in for a compiler: braces balance, dollar signs pair, every command is known."""
    known = F.array(*map(F.lit, L.KNOWN))
    fine = F.forall(F.regexp_extract_all(x, F.lit(r"\\[a-zA-Z]+"), F.lit(0)), lambda c: F.array_contains(known, c))
    return fine & (count_of(x, "{") == count_of(x, "}")) & (count_of(x, "$") % 2 == 0)


def gate(score: Column, compiles: Column, pass_at: float = PASS_AT, repair_at: float = REPAIR_AT) -> Column:
    return F.when(~compiles, "fallback").otherwise(let(score, lambda s: F.when(s >= pass_at, "pass").when(s >= repair_at, "repair").otherwise("fallback")))


def rank(g: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), g).cast("int") - 1


def crop_too_small(width: Column, height: Column) -> Column:
    return (width < MIN_CROP[0]) | (height < MIN_CROP[1])


def validate(df: DataFrame, latex: str, trusted: Column, compiles: Callable[[Column], Column] = proxy_compiles, attempts: int = 2) -> DataFrame:
    """Add normalized, score, gate, repair_attempts, error_code.

    No content: fallback with E402.empty. Otherwise up to ``attempts`` repairs, each kept only if
    the gate gets better; the score is that of what was kept. ``compiles`` is where a compiler plugs in.
    """
    def judge(x: Column, tries: Column) -> Column:
        """What a version of the formula is worth; the parts are worked out once each."""

        def scored(v: Column) -> Column:
            return F.struct(v.alias("x"), L.plausibility(v, trusted).alias("score"), compiles(v).alias("compiles"))

        def gated(j: Column) -> Column:
            return F.struct(j["x"].alias("x"), j["score"].alias("score"), j["compiles"].alias("compiles"), gate(j["score"], j["compiles"]).alias("gate"), tries.alias("tries"))

        return let(let(x, scored), gated)

    def attempt(j: Column) -> Column:
        new = judge(L.normalize(L.repair(j["x"])), j["tries"] + 1)
        return let(new, lambda n: F.when(rank(n["gate"]) < rank(j["gate"]), n).otherwise(j))

    best = judge(L.normalize(L.fix_row_breaks(L.unicode_to_latex(F.coalesce(F.col(latex), F.lit(""))))), F.lit(0))
    for _ in range(attempts):
        best = let(best, attempt)
    empty = F.coalesce(F.trim(latex) == "", F.lit(True))

    def outcome(j: Column) -> Column:
        failed = F.when(empty, "E402.empty").when(~j["compiles"], "E501").when(j["gate"] != "pass", "E503.plausibility")
        return F.struct(j["x"].alias("normalized"), F.when(empty, 0.0).otherwise(j["score"]).alias("score"), F.when(empty, "fallback").otherwise(j["gate"]).alias("gate"), j["tries"].alias("repair_attempts"), failed.alias("error_code"))

    names = ("normalized", "score", "gate", "repair_attempts", "error_code")
    return df.select("*", F.inline(F.array(let(best, outcome))).alias(*names))


def eligible(render_as_text: Column, kind: Column, canonical: Column) -> Column:
    """Rows that are validated and routed: formulas that are neither text, nor a label, nor a duplicate."""
    return ~F.coalesce(render_as_text, F.lit(False)) & ~kind.eqNullSafe("label") & canonical.isNull()


def retry_outcome(df: DataFrame, compiled: str) -> DataFrame:
    """After every fallback was compiled once more: success passes and drops the compiler's codes."""
    ok = (F.col("gate") == "fallback") & F.col(compiled)
    return df.withColumn("error_code", F.when(ok & F.col("error_code").isin("E501", "E502"), None).otherwise(F.col("error_code"))).withColumn("gate", F.when(ok, "pass").otherwise(F.col("gate")))


def draw_retry(df: DataFrame, again: Column, svg: str = "svg") -> DataFrame:
    """After drawings that failed were tried once more: success restores the pass, else the fallback."""
    failed = F.col("draw_error").isNotNull()
    out = df.withColumn("__again", F.when(failed, again)).withColumn("gate", F.when(F.col("__again").isNotNull(), "pass").when(failed, "fallback").otherwise(F.col("gate")))
    return out.withColumn(svg, F.coalesce("__again", svg)).withColumn("draw_error", F.when(F.col("__again").isNull(), F.col("draw_error"))).drop("__again")


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to draw (pass or repair) and rows for the fallback."""
    draw = F.col("gate").isin("pass", "repair")
    return df.filter(draw), df.filter(~draw)


def draw_outcome(df: DataFrame, svg: str) -> DataFrame:
    """After drawing: dangling references reject a drawing; failures go to the fallback with their code."""
    from ..functions.svg import orphans

    bad = F.when(F.col(svg).isNull(), "E601").when(F.size(orphans(F.col(svg))) > 0, "E602")
    return df.withColumn("draw_error", bad).withColumn(svg, F.when(bad.isNull(), F.col(svg))).withColumn("gate", F.when(bad.isNotNull(), "fallback").otherwise(F.col("gate")))


def fallback_outcome(df: DataFrame, recognised: str = "recognised_svg") -> DataFrame:
    """After the fallback service: what it drew, else flagged for review with E603."""
    ok = F.col(recognised).isNotNull()
    return df.withColumn("fallback_used", ok).withColumn("flagged", ~ok).withColumn("error_code", F.when(ok, F.col("error_code")).otherwise("E603")).withColumn("gate", F.when(ok, F.col("gate")).otherwise("flagged"))


def postprocess_outcome(df: DataFrame, raw: str, processed: str) -> DataFrame:
    """A drawing whose postprocessing failed stays as it was, with E701."""
    failed = F.col(processed).isNull() & F.col(raw).isNotNull()
    return df.withColumn("post_error", F.when(failed, "E701")).withColumn(processed, F.coalesce(processed, raw))
