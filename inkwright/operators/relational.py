"""Dedup, placeholder joins, footnote links, snapshot diffs, batches, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import text as T


# --- dedup -------------------------------------------------------------------------------------


def mark_duplicates(df: DataFrame, content: Column, order: list[str], row_id: str, scope: list[str] | None = None) -> DataFrame:
    """Add canonical: the id of the first row, in ``order``, of those with the same normal form in
    the same scope; null for rows without content and for canonical rows themselves.

    Two exchanges, an aggregate with map-side combining and a join that splits hot keys, instead of
    a window that would put all copies of one row into one task.
    """
    scope = scope or []
    keyed = df.withColumn("__k", F.sha2(L.dedup_key(content), 256))
    first = keyed.filter("__k is not null").groupBy(*scope, "__k").agg(F.min(F.struct(*order, F.col(row_id).alias("__id"))).alias("__first"))
    x, y = keyed.alias("x"), first.alias("y")
    cond = [F.col("x.__k") == F.col("y.__k"), *(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in scope)]
    head = F.col("y.__first.__id")
    return x.join(y, cond, "left").select(*[F.col(f"x.{c}") for c in df.columns], F.when(head != F.col(f"x.{row_id}"), head).alias("canonical"))


def is_mathml(latex: Column) -> Column:
    return latex.startswith("MATHML:")


def mark_mathml_duplicates(df: DataFrame, latex: str, order: list[str], row_id: str, scope: list[str] | None = None) -> DataFrame:
    """mark_duplicates among the rows that came as MathML; other rows are never duplicates."""
    return mark_duplicates(df, F.when(is_mathml(F.col(latex)), F.col(latex)), order, row_id, scope)


def copy_from_canonical(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Duplicates take the outcome of their canonical row, failures included."""
    source = df.filter("canonical is null").select(F.col(row_id).alias("canonical"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(source, "canonical", "left")
    return out.select(*[F.when(F.col("canonical").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- placeholders ------------------------------------------------------------------------------


def split_placeholders(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, pos, chunk, region: text cut at its placeholders; region is null for plain chunks."""
    gaps = F.split(text, T.PLACEHOLDER)
    ids = F.regexp_extract_all(text, F.lit(T.PLACEHOLDER), F.lit(1))
    one = lambda g, i: F.array(F.struct((2 * i).alias("pos"), g.alias("chunk"), F.lit(None).cast("string").alias("region")), F.struct((2 * i + 1).alias("pos"), F.lit("").alias("chunk"), F.get(ids, i).alias("region")))
    parts = F.flatten(F.transform(gaps, one))
    return df.select(*key, F.explode(F.filter(parts, lambda p: (p["chunk"] != "") | p["region"].isNotNull())).alias("p")).select(*key, "p.*")


def render_placeholders(df: DataFrame, regions: DataFrame, key: list[str], text: str, kind: str = "kind") -> DataFrame:
    """key, html: text with each placeholder replaced by its region's html (regions: region, html,
    display). Unknown regions become nothing. A display region splits its paragraph; code is left
    alone. Plain chunks are escaped and linked."""
    code = df.filter(F.col(kind) == "code").select(*key, F.concat(F.lit("<pre>"), T.escape(F.col(text)), F.lit("</pre>")).alias("html"))
    parts = split_placeholders(df.filter(F.col(kind) != "code"), key, text).join(regions, "region", "left")
    shown = F.when(F.col("region").isNull(), T.linkify(T.escape(F.col("chunk")))).when(F.col("display"), F.concat(F.lit("</p>"), F.col("html"), F.lit("<p>"))).otherwise(F.coalesce("html", F.lit("")))
    whole = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("s")))).alias("p"))
    body = F.concat(F.lit("<p>"), F.array_join("p.s", ""), F.lit("</p>"))
    return whole.select(*key, F.regexp_replace(body, r"<p>\s*</p>", "").alias("html")).unionByName(code)


def unplaced(regions: DataFrame, text_rows: DataFrame, text: str, region: str = "region") -> DataFrame:
    """Regions that no placeholder names."""
    named = text_rows.select(F.explode(F.regexp_extract_all(text, F.lit(T.PLACEHOLDER), F.lit(1))).alias(region)).distinct()
    return regions.join(named, region, "left_anti")


def region_html(kind: Column, display: Column, text_repr: Column, svg: Column, crop: Column, fallback: Column, flagged: Column, region: Column, number: Column) -> Column:
    """Markup of a region: text, else image (where flagged or not drawn and there is a crop), else
    fallback text, else the drawing; null where it is left out."""
    number = T.number_span(number)
    wrap = lambda inner: F.when(display, F.concat(F.lit('<div class="eq-display">'), number, inner, F.lit("</div>"))).otherwise(F.concat(F.lit('<span class="eq-inline">'), inner, F.lit("</span>")))
    span = lambda inner: F.concat(F.lit('<span class="eq-text">'), inner, F.lit("</span>"))
    image = F.format_string('<img class="eq-img-fallback" alt="equation %s" src="../images/%s.png"/>', region, region)
    bad = flagged | F.coalesce(svg == "", F.lit(True))
    return F.when(text_repr.isNotNull(), span(text_repr)).when(kind == "label", None).when(bad & crop, wrap(image)).when(bad & fallback.isNotNull(), span(T.escape(fallback))).when(~bad, wrap(svg))


# --- footnotes ---------------------------------------------------------------------------------


def link_footnotes(notes: DataFrame, markers: DataFrame, page: str = "page", number: str = "number") -> DataFrame:
    """page, number, note_id, marker_id where a number occurs exactly once on either side of its page."""
    once = lambda df, id_: df.filter(F.col(number).isNotNull()).groupBy(page, number).agg(F.count("*").alias("n"), F.min(id_).alias(id_)).filter("n = 1").drop("n")
    return once(notes, "note_id").join(once(markers, "marker_id"), [page, number])


# --- snapshots ---------------------------------------------------------------------------------

SNAPSHOT_FIELDS = ("raw_latex", "render_as_text", "inline_text_repr")


def snapshot_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("equations"), F.count_if(F.col("class") == "display").alias("display"), F.count_if(F.col("class") == "inline").alias("inline"),
        F.count_if("render_as_text").alias("render_as_text"), F.count_if("deduped").alias("deduped"), F.countDistinct("page").alias("pages"),
    )


def snapshot_diff(base: DataFrame, candidate: DataFrame, strict: bool = False, scope: list[str] | None = None) -> DataFrame:
    """Keys whose rows differ: status (added, removed, changed) and both raw_latex.

    Key: page, order, class, where the last row (by region_id) counts; strict adds an ordinal, so
    that rows that share a key are compared one by one.
    """
    key = [*(scope or []), "page", "order", "class"]
    order = F.struct("region_id", *SNAPSHOT_FIELDS)

    def keyed(df: DataFrame, side: str) -> DataFrame:
        if strict:
            rows = df.withColumn("ordinal", F.row_number().over(W.partitionBy(*key).orderBy("region_id", *SNAPSHOT_FIELDS)))
            return rows.select(*key, "ordinal", F.struct(*SNAPSHOT_FIELDS).alias(side))
        last = df.groupBy(*key).agg(F.max(order).alias("last"))
        return last.select(*key, F.struct(*[F.col(f"last.{c}").alias(c) for c in SNAPSHOT_FIELDS]).alias(side))

    names = [*key, *(["ordinal"] if strict else [])]
    both = keyed(base, "b").alias("x").join(keyed(candidate, "c").alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in names], "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("b").eqNullSafe(F.col("c")), "changed")
    rows = both.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in names], status.alias("status"), F.col("b.raw_latex").alias("base_latex"), F.col("c.raw_latex").alias("candidate_latex"))
    return rows.filter("status is not null")


def diff_summary(base: DataFrame, diff: DataFrame) -> DataFrame:
    """added, removed, changed, pct_changed (of distinct base keys, one at least), identical."""
    keys = base.select("page", "order", "class").distinct().agg(F.count("*").alias("keys"))
    n = lambda s: F.count_if(F.col("status") == s)
    got = diff.agg(n("added").alias("added"), n("removed").alias("removed"), n("changed").alias("changed"))
    return got.join(keys).select("added", "removed", "changed", F.round(100.0 * F.col("changed") / F.greatest("keys", F.lit(1)), 2).alias("pct_changed"), ((F.col("added") == 0) & (F.col("removed") == 0) & (F.col("changed") == 0)).alias("identical"))


# --- batches -----------------------------------------------------------------------------------


def page_batches(df: DataFrame, total: str, size: Column) -> DataFrame:
    """first, last (inclusive, from 0) of each range of pages; one range where size is 0 or covers all."""
    n = F.col(total)
    step = F.when((size <= 0) | (size >= n), F.greatest(n, F.lit(1))).otherwise(size)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, step.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = df.select("*", step.cast("long").alias("__step"), F.explode(starts).alias("first"))
    last = F.least(F.col("first") + F.col("__step"), n.cast("long")) - 1
    return rows.withColumn("last", last).withColumn("dir", F.format_string("batch_%05d_%05d", "first", "last")).drop("__step")


def batch_timeout(pages: Column, explicit: Column, per_page: Column) -> Column:
    return F.coalesce(explicit, F.greatest(F.lit(600), pages * per_page))


def layout_check(expected: DataFrame, actual: DataFrame, key: str = "dir") -> DataFrame:
    """Batches that only one side has: unexpected ones are errors, missing ones can be resumed. One exchange."""
    both = expected.select(key, F.lit(True).alias("expected")).unionByName(actual.select(key, F.lit(False).alias("expected")))
    sides = both.groupBy(key).agg(F.bool_or("expected").alias("e"), F.bool_and("expected").alias("only"))
    return sides.filter("only or not e").select(key, F.when(F.col("only"), "missing").otherwise("unexpected").alias("status"))


def with_lookup(df: DataFrame, cache: DataFrame, key: str, guard: str | None = None) -> DataFrame:
    """Rows with the cached value of their key, and hit; a guard column must agree as well."""
    on = [key, *([guard] if guard else [])]
    return df.join(cache.withColumn("hit", F.lit(True)), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


# --- metrics -----------------------------------------------------------------------------------


def run_totals(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, passed, repaired, fallback, flagged; the classes overlap."""
    c = F.count_if
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), c(F.col("gate") == "pass").alias("passed"), c((F.col("repair_attempts") > 0) & ~F.col("flagged")).alias("repaired"),
        c("fallback_used").alias("fallback"), c("flagged").alias("flagged"),
    )


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.round(hits / F.nullif(hits + misses, F.lit(0)), 4), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * part / F.greatest(whole, F.lit(1)))


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%d m %02d s", F.floor(s / 60).cast("long"), s % 60)


def first_with_rest(df: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows in order, and how many there are besides."""
    return df.orderBy(*order).limit(limit), df.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))


ERROR_EVENTS = ("equation_error", "stage_end_error")


def error_events(df: DataFrame, kinds: tuple[str, ...] = ERROR_EVENTS, column: str = "event_type") -> DataFrame:
    """Events of the kinds, with the rank of their kind; a report lists them by rank, then time."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col(column)).cast("int")
    return df.filter(F.col(column).isin(*kinds)).withColumn("kind_rank", rank)


def report_worthy(crop: Column, flagged: Column, fallback: Column, gate: Column) -> Column:
    return crop & (flagged | fallback | ~gate.eqNullSafe("pass"))
