"""Queries on pages, documents, conversations, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.strings import squeeze
from ..operators import markup as M
from ..operators import ordered as O
from ..operators import relational as R
from ..sources import epub as E
from ..sources import formats as S
from ..streaming import logs
from .latex_queries import _compiles_sql, _score_sql

SPAN = r"\$\$(?s:.+?)\$\$|\\\[(?s:.+?)\\\]|\\\((?s:.+?)\\\)|\$[^$\n]+?\$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- markup ------------------------------------------------------------------------------------


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.title(F.col("html")).alias("title"))


def page_blocks(spark, sf_dir):
    return M.page_blocks(table(spark, sf_dir, "pages"))


def block_kind_counts(spark, sf_dir):
    return page_blocks(spark, sf_dir).groupBy("kind", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def page_walk(spark, sf_dir):
    return M.walk_pages(table(spark, sf_dir, "pages")).select("page_id", "row", "id", "kind", "seq", "text", "recovered")


_DECODE = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:script)\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'gsi'), '^.*?<body[^>]*>', '', 'si'), '</body>.*$', '', 'si')"
_TAGS = "p|li|dd|dt|h1|h2|h3|h4|h5|h6|div|footer"
_BLOCKS = f"""(SELECT page_id, seq, lower(string_split(s, chr(2))[1]) AS tag, regexp_replace({_DECODE.format("regexp_replace(string_split(s, chr(2))[2], '<[^>]+>', '', 'g')")}, '^\\s+|\\s+$', '', 'g') AS text FROM
 (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1)::INT - 1 AS seq FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace({_BODY}, '<({_TAGS})(?:\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'gi'), '</(?:{_TAGS})\\s*>', chr(1), 'gi'), chr(1)), lambda s: contains(s, chr(2))) AS l FROM pages)))"""
_KIND = "CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag IN ('li', 'dd') THEN 'list_item' ELSE 'text' END"
_BLOCK_ROWS = f"(SELECT page_id, seq, tag, {_KIND} AS kind, text FROM {_BLOCKS} WHERE text <> '')"


# --- delimiters, placeholders, dedup -----------------------------------------------------------


def spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(T.delimiters(F.col("text"))).alias("pos", "span"))
    return rows.select("doc_id", F.col("pos").cast("int").alias("pos"), F.when(T.is_display(F.col("span")), "display").otherwise("inline").alias("formula_class"), T.inside(F.col("span")).alias("latex"))


def span_class_counts(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("formula_class").agg(F.count("*").alias("n"), F.sum(F.length("latex")).alias("chars"))


_SPANS = f"(SELECT doc_id, unnest(l) AS span, generate_subscripts(l, 1)::INT - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{SPAN}') AS l FROM documents))"
_SPAN_ROWS = f"(SELECT doc_id, pos, CASE WHEN span[1:2] = '$$' OR span[1:2] = '\\[' THEN 'display' ELSE 'inline' END AS formula_class, regexp_replace(CASE WHEN span[1:2] = '$$' OR span[1] = '\\' THEN span[3:-3] ELSE span[2:-2] END, '^\\s+|\\s+$', '', 'g') AS latex FROM {_SPANS})"


def _turns(spark, sf_dir):
    """Turns with a placeholder after each, for the regions of the turn and of one that is missing."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("text").alias("kind"), F.concat("text", F.lit(" [[EQ:eq_"), F.col("turn"), F.lit("]] and [[EQ:none]].")).alias("raw"))


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("eq_"), F.col("turn")).alias("region"), F.concat(F.lit("<i>"), F.col("turn"), F.lit("</i>")).alias("html"), (F.col("turn") % 2 == 0).alias("display")).distinct()


def placeholder_render(spark, sf_dir):
    return R.render_placeholders(_turns(spark, sf_dir), _regions(spark, sf_dir), ["conv_id", "turn"], "raw")


def unplaced_equations(spark, sf_dir):
    """Regions of all turns, and of as many that no turn names."""
    regions = _regions(spark, sf_dir)
    return R.unplaced(regions.union(regions.withColumn("region", F.concat("region", F.lit("_b")))), _turns(spark, sf_dir), "raw")


def dedup_canonical(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.mark_duplicates(docs, F.col("text"), ["doc_id"], "doc_id").select("doc_id", "canonical")


def dedup_stats(spark, sf_dir):
    return dedup_canonical(spark, sf_dir).agg(F.count("*").alias("n"), F.count("canonical").alias("duplicates"), F.countDistinct("canonical").alias("groups"))


def copy_canonical(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = R.mark_duplicates(docs, F.col("text"), ["doc_id"], "doc_id")
    return R.copy_from_canonical(rows, "doc_id", ["source", "n_chars"]).select("doc_id", "source", "n_chars")


_NORMAL_TEXT = "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
_CANON = f"(SELECT doc_id, source, n_chars, nullif(min(doc_id) OVER (PARTITION BY {_NORMAL_TEXT}), doc_id) AS canonical FROM documents)"


def region_markup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("display"), F.when(F.col("o_custkey") % 5 == 0, "<b>v</b>").alias("text_repr"), F.when(F.col("o_custkey") % 3 != 0, "<svg/>").alias("svg"), (F.col("o_custkey") % 2 == 0).alias("crop"), F.when(F.col("o_custkey") % 7 != 0, "a<b").alias("fallback"), (F.col("o_orderkey") % 11 == 0).alias("flagged"), F.when(F.col("o_orderkey") % 4 == 0, "(1)").alias("number"))
    html = R.region_html(F.lit("formula"), F.col("display"), F.col("text_repr"), F.col("svg"), F.col("crop"), F.col("fallback"), F.col("flagged"), F.concat(F.lit("eq_"), F.col("id")), F.col("number"))
    return rows.select("id", html.alias("html"))


_REGIONS = """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS display, o_custkey % 5 = 0 AS shown, o_custkey % 3 <> 0 AS drawn, o_custkey % 2 = 0 AS crop, o_custkey % 7 <> 0 AS fallback, o_orderkey % 11 = 0 AS flagged, CASE WHEN o_orderkey % 4 = 0 THEN '<span class="eq-number">(1)</span>' ELSE '' END AS number FROM orders),
i AS (SELECT *, CASE WHEN shown THEN NULL WHEN (flagged OR NOT drawn) AND crop THEN '<img class="eq-img-fallback" alt="equation eq_' || id || '" src="../images/eq_' || id || '.png"/>' WHEN NOT flagged AND drawn THEN '<svg/>' END AS inside FROM r)
SELECT id, CASE WHEN shown THEN '<span class="eq-text"><b>v</b></span>' WHEN (flagged OR NOT drawn) AND NOT crop AND fallback THEN '<span class="eq-text">a&lt;b</span>' WHEN display THEN '<div class="eq-display">' || number || inside || '</div>' ELSE '<span class="eq-inline">' || inside || '</span>' END AS html FROM i"""


def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.escape(F.col("text")), 256).alias("escaped"), F.sha2(T.escape_alt(F.col("text")), 256).alias("alt"))


def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see ("), F.col("url"), F.lit("). Then")).alias("x"))
    return pages.select("page_id", T.linkify(T.escape(F.col("x"))).alias("html"))


def note_markup(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("fn_1_"), F.col("s_suppkey"))).alias("note"), F.col("s_name").alias("inner"))
    return rows.select("s_suppkey", T.footnote_html(F.col("note"), F.col("inner"), F.col("s_suppkey") % 2 == 0).alias("footnote"), T.noteref_html(F.col("note"), F.col("inner")).alias("noteref"), T.number_span(F.col("inner")).alias("number"))


# --- order -------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return rows.select("doc_id", "line", F.lit("text").alias("kind"), F.col("t").alias("text"))


def continuation_merge(spark, sf_dir):
    got = O.merge_continuations(_lines(spark, sf_dir), "doc_id", "line")
    return got.select("doc_id", F.col("first").alias("line"), F.col("parts").cast("int").alias("parts"), F.sha2("text", 256).alias("digest"))


_LINES = "(SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
# lines end without white space here, and none ends in a hyphen, so parts are joined by spaces
_MERGED = f"""SELECT doc_id, min(line) AS line, count(*)::INT AS parts, sha256(string_agg(text, ' ' ORDER BY line)) AS digest FROM (
 SELECT *, sum(CASE WHEN p IS NOT NULL AND trim(p) <> '' AND NOT regexp_matches(p, '[.!?:;…"”''’)\\]]\\s*$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS island
 FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM {_LINES})) GROUP BY doc_id, island"""


def _page_units(spark, sf_dir):
    blocks = page_blocks(spark, sf_dir).select("page_id", F.lit(1).alias("page"), (F.col("seq") % 7).cast("double").alias("order"), F.lit(0.0).alias("y0"), "seq", "kind", "text")
    part = lambda c: blocks.filter(c)
    return O.units(part("kind = 'text'"), part("kind = 'list_item'"), part("kind = 'heading'"))


def reading_order(spark, sf_dir):
    return O.reading_order(_page_units(spark, sf_dir), "page_id").select("page_id", F.col("pos").cast("int").alias("pos"), "unit", "seq")


def chapters_by_heading(spark, sf_dir):
    rows = O.chapters_by_heading(page_blocks(spark, sf_dir), "page_id", "seq")
    return rows.select("page_id", "seq", F.col("chapter").cast("int").alias("chapter"), "chapter_title")


def chapters_by_page(spark, sf_dir):
    """Conversations as books of three turns a page."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("page"))
    titles = rows.filter("page % 2 = 0").select("conv_id", "page", F.concat(F.lit("Page "), F.col("page")).alias("title")).distinct()
    got = O.chapters_by_page(rows.withColumn("stem", F.lit("book")), "conv_id", "turn", "page", titles, "stem")
    return got.select("conv_id", "turn", F.col("chapter").cast("int").alias("chapter"), "chapter_title")


def toc_rows(spark, sf_dir):
    rows = page_blocks(spark, sf_dir).withColumn("title", F.when(F.col("kind") == "heading", F.col("text"))).withColumn("volume", (F.col("page_id") % 5).cast("int"))
    order = F.col("page_id") * 100000 + F.col("seq")
    return O.toc(rows.withColumn("o", order), ["volume"], "o").select("volume", "page_id", "title", F.col("toc_no").cast("int").alias("toc_no"))


def chapter_size_split(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text").cast("long")).withColumn("head", F.col("turn") % 4 == 1)
    return O.size_split(rows.select("conv_id", "turn", "chars", "head"), "conv_id", "turn", "chars", heading="head", budget=400).select("conv_id", "turn", "file", "split")


_SIZE_SPLIT = """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS chars, turn % 4 = 1 AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, 0 AS file, false AS split, chars AS held, head FROM t WHERE k = 1
 UNION ALL SELECT t.conv_id, t.turn, t.k, f.file + (NOT f.head AND f.held + t.chars > 400)::INT, NOT f.head AND f.held + t.chars > 400, CASE WHEN NOT f.head AND f.held + t.chars > 400 THEN t.chars ELSE f.held + t.chars END, t.head FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, turn, file, split FROM f"""


def volume_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 500).alias("n"), (F.col("turn") % 2 == 0).alias("titled"))
    return O.pack_volumes(rows, "conv_id", "turn", "n", "titled")


_VOLUMES = """WITH RECURSIVE t AS (SELECT conv_id, turn, (length(text) % 500)::BIGINT AS n, turn % 2 = 0 AS titled, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
g AS (SELECT *, sum((titled OR k = 1)::INT) OVER (PARTITION BY conv_id ORDER BY k) AS grp FROM t),
s AS (SELECT conv_id, grp, sum(n)::BIGINT AS n FROM g GROUP BY conv_id, grp),
f AS (SELECT conv_id, grp, 0 AS volume, n AS held FROM s WHERE grp = 1
 UNION ALL SELECT s.conv_id, s.grp, f.volume + (f.held + s.n > 900)::INT, CASE WHEN f.held + s.n > 900 THEN s.n ELSE f.held + s.n END FROM f JOIN s ON s.conv_id = f.conv_id AND s.grp = f.grp + 1)
SELECT g.conv_id, g.turn, f.volume FROM g JOIN f USING (conv_id, grp)"""


# --- notes, snapshots, batches -----------------------------------------------------------------


def _event_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("page"), F.get_json_object("props", "$.k").alias("number"))


def _sides(spark, sf_dir):
    rows = _event_numbers(spark, sf_dir)
    side = lambda odd, name: rows.filter(F.col("event_id") % 2 == odd).select("page", "number", F.col("event_id").alias(name))
    return side(0, "note_id"), side(1, "marker_id")


def footnote_links(spark, sf_dir):
    return R.link_footnotes(*_sides(spark, sf_dir))


_EV = "(SELECT event_id, user_id AS page, json_extract_string(props, '$.k') AS number FROM events)"
_LINK = f"SELECT page, number, note_id, marker_id FROM (SELECT page, number, min(event_id) AS note_id FROM {_EV} WHERE event_id % 2 = 0 AND number IS NOT NULL GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT page, number, min(event_id) AS marker_id FROM {_EV} WHERE event_id % 2 = 1 AND number IS NOT NULL GROUP BY ALL HAVING count(*) = 1) USING (page, number)"


def note_placement(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("file", F.floor(F.col("turn") / 4).cast("int"))
    files = conv.groupBy("conv_id", "file").agg(F.max("turn").alias("max_page"))
    notes = conv.select("conv_id", F.col("turn").alias("note_id"), F.col("turn").alias("page"))
    markers = conv.filter("role = 'user'").select("conv_id", F.col("turn").alias("note_id"), "file")
    return O.place_notes(notes, files, markers, "conv_id")


_PLACE = """WITH c AS (SELECT conv_id, turn, role, floor(turn / 4)::INT AS file FROM conversations), f AS (SELECT conv_id, file, max(turn) AS max_page FROM c GROUP BY ALL)
SELECT n.conv_id, n.turn AS note_id, coalesce((SELECT min(m.file) FROM c m WHERE m.conv_id = n.conv_id AND m.turn = n.turn AND m.role = 'user'), (SELECT min(f.file) FROM f WHERE f.conv_id = n.conv_id AND f.max_page > n.turn), (SELECT max(f.file) FROM f WHERE f.conv_id = n.conv_id)) AS file, n.role = 'user' AS linked FROM c n"""


def _snapshot(spark, sf_dir, changed):
    """Order lines as the rows of a snapshot; the second one has lost, gained and changed some."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.floor(F.col("l_linenumber") / 2).cast("double").alias("order"), F.when(F.col("l_linenumber") % 3 == 0, "display").otherwise("inline").alias("class"), F.format_string("eq_%d_%d", "l_orderkey", "l_linenumber").alias("region_id"), F.concat(F.lit("x_{"), F.col("l_partkey"), F.lit("}")).alias("raw_latex"), (F.col("l_partkey") % 7 == 0).alias("render_as_text"), F.when(F.col("l_partkey") % 7 == 0, "x").alias("inline_text_repr"), (F.col("l_suppkey") % 9 == 0).alias("deduped"))
    if not changed:
        return rows.filter("page % 10 <> 9")
    return rows.filter("page % 10 <> 8").withColumn("raw_latex", F.when(F.col("page") % 4 == 0, F.concat("raw_latex", F.lit("'"))).otherwise(F.col("raw_latex")))


_SNAP = "SELECT l_orderkey AS page, floor(l_linenumber / 2)::DOUBLE AS \"order\", CASE WHEN l_linenumber % 3 = 0 THEN 'display' ELSE 'inline' END AS class, 'eq_' || l_orderkey || '_' || l_linenumber AS region_id, 'x_{' || l_partkey || '}' AS raw_latex, l_partkey % 7 = 0 AS render_as_text, CASE WHEN l_partkey % 7 = 0 THEN 'x' END AS inline_text_repr, l_suppkey % 9 = 0 AS deduped FROM lineitem"
_BASE = f"(SELECT * FROM ({_SNAP}) WHERE page % 10 <> 9)"
_CAND = f"(SELECT * REPLACE (CASE WHEN page % 4 = 0 THEN raw_latex || '''' ELSE raw_latex END AS raw_latex) FROM ({_SNAP}) WHERE page % 10 <> 8)"


def _diff_sql(strict: bool) -> str:
    key = 'page, "order", class'
    if strict:
        side = lambda t, key=key: f"(SELECT {key}, raw_latex, render_as_text, inline_text_repr, row_number() OVER (PARTITION BY {key} ORDER BY region_id, raw_latex) AS ordinal FROM {t})"
    else:
        side = lambda t, key=key: f"(SELECT {key}, raw_latex, render_as_text, inline_text_repr FROM {t} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY region_id DESC, raw_latex DESC, render_as_text DESC) = 1)"
    key += ", ordinal" if strict else ""
    return f"SELECT {key}, CASE WHEN b.raw_latex IS NULL THEN 'added' WHEN c.raw_latex IS NULL THEN 'removed' ELSE 'changed' END AS status, b.raw_latex AS base_latex, c.raw_latex AS candidate_latex FROM {side(_BASE)} b FULL JOIN {side(_CAND)} c USING ({key}) WHERE b.raw_latex IS NULL OR c.raw_latex IS NULL OR b.raw_latex <> c.raw_latex OR b.render_as_text <> c.render_as_text OR b.inline_text_repr IS DISTINCT FROM c.inline_text_repr"


def snapshot_counts(spark, sf_dir):
    return R.snapshot_counts(_snapshot(spark, sf_dir, False))


def snapshot_diff(spark, sf_dir):
    return R.snapshot_diff(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True))


def snapshot_diff_strict(spark, sf_dir):
    return R.snapshot_diff(_snapshot(spark, sf_dir, False), _snapshot(spark, sf_dir, True), strict=True).withColumn("ordinal", F.col("ordinal").cast("long"))


def snapshot_summary(spark, sf_dir):
    return R.diff_summary(_snapshot(spark, sf_dir, False), snapshot_diff(spark, sf_dir))


def _books(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 400).alias("pages"), (F.col("o_orderkey") % 90).alias("size"))


def page_batches(spark, sf_dir):
    return R.page_batches(_books(spark, sf_dir), "pages", F.col("size")).select("book", "first", "last", "dir")


_BOOKS = "(SELECT o_orderkey AS book, o_custkey % 400 AS pages, o_orderkey % 90 AS size FROM orders)"
_BATCHES = f"(SELECT book, f AS first, least(f + step, pages) - 1 AS last, printf('batch_%05d_%05d', f, least(f + step, pages) - 1) AS dir FROM (SELECT *, unnest(generate_series(0::BIGINT, pages - 1, step)) AS f FROM (SELECT *, CASE WHEN size <= 0 OR size >= pages THEN greatest(pages, 1) ELSE size END AS step FROM {_BOOKS}) WHERE pages > 0))"


def batch_rebase(spark, sf_dir):
    rows = page_batches(spark, sf_dir)
    offset = F.coalesce(F.regexp_extract("dir", r"batch_(\d+)_", 1).try_cast("int"), F.lit(0))
    return rows.groupBy("book").agg(F.count("*").alias("batches"), F.sum(offset).alias("offsets"), F.max(R.batch_timeout(F.col("last") - F.col("first") + 1, F.lit(None).cast("long"), F.lit(20))).alias("timeout"))


def layout_check(spark, sf_dir):
    rows = page_batches(spark, sf_dir).select(F.concat_ws("/", "book", "dir").alias("dir"), "first", "last")
    return R.layout_check(rows.filter("first % 7 <> 0 or first = 0"), rows.filter("last % 5 <> 0"))


# --- events and metrics ------------------------------------------------------------------------


def run_totals(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gate = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "repair")
    rows = docs.join(labels, "doc_id", "left").select("lang", gate.alias("gate"), F.coalesce(F.col("toxic"), F.lit(0)).alias("repair_attempts"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("flagged"), (F.col("n_chars") < 500).alias("fallback_used"))
    return R.run_totals(rows, ["lang"])


def stage_metrics(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), R.hit_rate(F.count_if(F.col("value") > 50), F.count_if(F.col("value") <= 50)).alias("hit_rate"))


def error_events(spark, sf_dir):
    kinds = ("signup", "purchase")
    return R.error_events(table(spark, sf_dir, "events"), kinds).select("event_id", "event_type", "kind_rank")


def report_crops(spark, sf_dir):
    """The first 200 documents worth a look, in order of their ids; the limit is the report's own."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").filter(R.report_worthy(F.lit(True), F.col("toxic") == 1, F.lit(False), F.when(F.col("quality") == 1, "pass").otherwise("repair")))
    return R.first_with_rest(rows.select("doc_id", "quality", "toxic"), ["doc_id"], 200)[0]


def cache_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("key"))
    cache = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("key")).groupBy("key").agg(F.min("doc_id").alias("cached"))
    return R.with_lookup(docs, cache, "key").select("doc_id", "cached", "hit")


def scanned_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return S.scanned_vote(rows)


def column_layout(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("double").alias("x1"), F.lit(600.0).alias("page_width"))
    return S.column_layout(rows)


def source_kinds(spark, sf_dir):
    p = F.concat(F.col("p_name"), F.get(F.array(*map(F.lit, (".epub", ".HTML", ".pdf", ".txt", ""))), (F.col("p_partkey") % 5).cast("int")))
    kinds = table(spark, sf_dir, "part").select("p_partkey", S.source_kind(p, F.col("p_size") % 2 == 0).alias("kind"), S.is_math_font(F.concat(F.get(F.array(*map(F.lit, ("CMMI10", "Times", "msbm7"))), (F.col("p_partkey") % 3).cast("int")))).alias("math_font"))
    return kinds.withColumn("pdf_kind", S.pdf_kind(F.col("p_partkey") % 4 == 0, F.col("math_font"))).withColumn("pdf_error", S.pdf_error(F.col("p_partkey") % 10 == 0, F.col("p_partkey") % 3))


def crop_boxes(spark, sf_dir):
    p = F.col
    rows = table(spark, sf_dir, "part").select("p_partkey", S.crop_box(p("p_size") * 1.0, p("p_size") * 2.0, p("p_size") * 3.0, p("p_size") * 2.0, F.lit(2.0), F.lit(0.25), F.lit(200), F.lit(100)).alias("b"))
    return rows.select("p_partkey", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def file_guards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit('<svg><path id="a"/><use href="#b"/></svg><svg><path id="b"/></svg>')).alias("xhtml"))
    got = E.guards(docs)
    return got.select("doc_id", F.col("bytes").cast("long").alias("bytes"), "too_large", F.array_join("dangling", ",").alias("dangling"), T.check_timeout(F.col("bytes") * 100).alias("timeout"))


def log_progress(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("page "), F.col("event_id"), F.lit(" / "), F.col("user_id")).alias("line"))
    return ev.select("event_id", T.progress(F.col("line")).alias("p")).select("event_id", "p.done", "p.total")


def stall_gaps(spark, sf_dir):
    got = logs.stall_gaps(table(spark, sf_dir, "events"), "user_id", "ts", 86400.0, ["event_id"])
    return got.select("user_id", "since", "until", F.round("gap_s", 3).alias("gap_s"))


def hourly_event_windows(spark, sf_dir):
    got = logs.event_windows(table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def page_counters(spark, sf_dir):
    """The flagship: pages to blocks to formulas, deduplicated, scored and counted page by page."""
    from ..functions import latex as L
    from ..operators import gate as G

    # each exchange is made once and read by all that follows, so nothing upstream is worked out again
    blocks = page_blocks(spark, sf_dir).repartition("page_id")
    found = blocks.select("page_id", "seq", F.posexplode(T.delimiters(F.col("text"))).alias("pos", "span"))
    rows = found.select("page_id", F.col("seq").alias("block"), "pos", T.inside(F.col("span")).alias("latex"), F.concat_ws("_", F.lit("eq"), "page_id", "seq", "pos").alias("region"))
    rows = rows.repartition("page_id")
    rows = R.mark_duplicates(rows, F.col("latex"), ["page_id", "block", "pos"], "region", ["page_id"])
    rows = rows.withColumn("gate", G.gate(L.plausibility(F.col("latex"), F.lit(True)), G.proxy_compiles(F.col("latex"))))
    eq = rows.groupBy("page_id").agg(F.count("*").alias("equations"), F.count("canonical").alias("deduped"), F.count_if(F.col("gate") == "pass").alias("passed"))
    per_page = blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.sum(F.length("text")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return per_page.join(eq, "page_id", "left").select("page_id", "blocks", "headings", "chars", zero("equations"), zero("deduped"), zero("passed"))


QUERIES = {f.__name__: f for f in (page_counters, page_titles, page_blocks, block_kind_counts, page_walk, span_class_counts, placeholder_render, unplaced_equations, dedup_canonical, dedup_stats, copy_canonical, region_markup, escape_text, page_links, note_markup, continuation_merge, reading_order, chapters_by_heading, chapters_by_page, toc_rows, chapter_size_split, volume_pack, footnote_links, note_placement, snapshot_counts, snapshot_diff, snapshot_diff_strict, snapshot_summary, page_batches, batch_rebase, layout_check, run_totals, stage_metrics, error_events, report_crops, cache_lookup, scanned_vote, column_layout, source_kinds, crop_boxes, file_guards, log_progress, stall_gaps, hourly_event_windows)} | {"delimiter_spans": spans}

_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_EQ = f"(SELECT page_id, seq, generate_subscripts(l, 1) AS pos, unnest(l) AS span FROM (SELECT page_id, seq, regexp_extract_all(text, '{SPAN}') AS l FROM {_BLOCK_ROWS}))"
_COUNTERS = f"""WITH b AS (SELECT page_id, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, sum(length(text))::BIGINT AS chars FROM {_BLOCK_ROWS} GROUP BY page_id),
s AS (SELECT *, regexp_replace(CASE WHEN span[1:2] = '$$' OR span[1] = chr(92) THEN span[3:-3] ELSE span[2:-2] END, '^\\s+|\\s+$', '', 'g') AS x FROM {_EQ}),
e AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id, regexp_replace(x, '\\s+', ' ', 'g') ORDER BY seq, pos) > 1 AS dup, {_score_sql('x', 'true')} >= 0.65 AND {_compiles_sql('x')} AS ok FROM s),
g AS (SELECT page_id, count(*) AS equations, count(*) FILTER (dup) AS deduped, count(*) FILTER (ok) AS passed FROM e GROUP BY page_id)
SELECT b.*, coalesce(equations, 0) AS equations, coalesce(deduped, 0) AS deduped, coalesce(passed, 0) AS passed FROM b LEFT JOIN g USING (page_id)"""
ORACLES = {
    "page_counters": _COUNTERS,
    "page_titles": f"SELECT page_id, regexp_replace(regexp_replace({_DECODE.format('''regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')''')}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS title FROM pages",
    "page_blocks": f"SELECT * FROM {_BLOCK_ROWS}",
    "block_kind_counts": f"SELECT kind, tag, count(*) AS n, sum(length(text))::BIGINT AS chars FROM {_BLOCK_ROWS} GROUP BY kind, tag",
    "delimiter_spans": f"SELECT * FROM {_SPAN_ROWS}",
    "span_class_counts": f"SELECT formula_class, count(*) AS n, sum(length(latex))::BIGINT AS chars FROM {_SPAN_ROWS} GROUP BY formula_class",
    "placeholder_render": f"SELECT conv_id, turn, '<p>' || {_ESC.format('text')} || ' ' || CASE WHEN turn % 2 = 0 THEN '</p><i>' || turn || '</i><p>' ELSE '<i>' || turn || '</i>' END || ' and .</p>' AS html FROM conversations",
    "unplaced_equations": "SELECT DISTINCT 'eq_' || turn || '_b' AS region, '<i>' || turn || '</i>' AS html, turn % 2 = 0 AS display FROM conversations",
    "dedup_canonical": f"SELECT doc_id, canonical FROM {_CANON}",
    "dedup_stats": f"SELECT count(*) AS n, count(canonical) AS duplicates, count(DISTINCT canonical) AS groups FROM {_CANON}",
    "copy_canonical": f"SELECT a.doc_id, coalesce(b.source, a.source) AS source, coalesce(b.n_chars, a.n_chars) AS n_chars FROM {_CANON} a LEFT JOIN documents b ON b.doc_id = a.canonical",
    "region_markup": _REGIONS,
    "escape_text": f"SELECT doc_id, sha256({_ESC.format('text')}) AS escaped, sha256({_ESC.format('''replace(text, '>', '＞')''')}) AS alt FROM documents",
    "page_links": f"SELECT page_id, 'see (<a href=\"' || {_ESC.format('url')} || '\">' || {_ESC.format('url')} || '</a>). Then' AS html FROM pages",
    "note_markup": f"SELECT s_suppkey, '<p class=\"footnote\"' || CASE WHEN s_suppkey % 3 <> 0 THEN ' id=\"fn_1_' || s_suppkey || '\"' ELSE '' END || '>' || s_name || CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN ' <a class=\"footnote-back\" href=\"#fnref_1_' || s_suppkey || '\">↩</a>' ELSE '' END || '</p>' AS footnote, CASE WHEN s_suppkey % 3 = 0 THEN '<span class=\"eq-text\">' || s_name || '</span>' ELSE '<a class=\"noteref\" id=\"fnref_1_' || s_suppkey || '\" href=\"#fn_1_' || s_suppkey || '\"><span class=\"eq-text\">' || s_name || '</span></a>' END AS noteref, '<span class=\"eq-number\">' || s_name || '</span>' AS number FROM supplier",
    "continuation_merge": _MERGED,
    "reading_order": f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY seq % 7, CASE kind WHEN 'text' THEN 0 WHEN 'list_item' THEN 1 ELSE 2 END, seq) - 1)::INT AS pos, CASE kind WHEN 'text' THEN 'text' WHEN 'list_item' THEN 'figure' ELSE 'equation' END AS unit, seq FROM {_BLOCK_ROWS}",
    "chapters_by_heading": f"SELECT page_id, seq, sum((kind = 'heading')::INT) OVER w::INT AS chapter, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER w AS chapter_title FROM {_BLOCK_ROWS} WINDOW w AS (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "chapters_by_page": "SELECT conv_id, turn, (dense_rank() OVER (PARTITION BY conv_id ORDER BY floor(turn / 3)) - 1)::INT AS chapter, CASE WHEN floor(turn / 3)::INT % 2 = 0 THEN 'Page ' || floor(turn / 3)::INT ELSE 'book' END AS chapter_title FROM conversations",
    "toc_rows": f"SELECT (page_id % 5)::INT AS volume, page_id, text AS title, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id, seq)::INT AS toc_no FROM {_BLOCK_ROWS} WHERE kind = 'heading'",
    "chapter_size_split": _SIZE_SPLIT,
    "volume_pack": _VOLUMES,
    "footnote_links": _LINK,
    "note_placement": _PLACE,
    "snapshot_counts": f"SELECT count(*) AS equations, count(*) FILTER (class = 'display') AS display, count(*) FILTER (class = 'inline') AS inline, count(*) FILTER (render_as_text) AS render_as_text, count(*) FILTER (deduped) AS deduped, count(DISTINCT page) AS pages FROM {_BASE}",
    "snapshot_diff": _diff_sql(False),
    "snapshot_diff_strict": _diff_sql(True),
    "snapshot_summary": f"SELECT added, removed, changed, round(100.0::DOUBLE * changed / greatest(keys, 1), 2) AS pct_changed, added + removed + changed = 0 AS identical FROM (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed FROM ({_diff_sql(False)})), (SELECT count(*) AS keys FROM (SELECT DISTINCT page, \"order\", class FROM {_BASE}))",
    "page_batches": f"SELECT * FROM {_BATCHES}",
    "batch_rebase": f"SELECT book, count(*) AS batches, sum(first)::BIGINT AS offsets, max(greatest(600, (last - first + 1) * 20)) AS timeout FROM {_BATCHES} GROUP BY book",
    "layout_check": f"WITH b AS (SELECT book || '/' || dir AS dir, first, last FROM {_BATCHES}), e AS (SELECT dir FROM b WHERE first % 7 <> 0 OR first = 0), a AS (SELECT dir FROM b WHERE last % 5 <> 0) SELECT dir, 'unexpected' AS status FROM (SELECT dir FROM a EXCEPT SELECT dir FROM e) UNION ALL SELECT dir, 'missing' FROM (SELECT dir FROM e EXCEPT SELECT dir FROM a)",
    "run_totals": "SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS passed, 0::BIGINT AS repaired, count(*) FILTER (n_chars < 500) AS fallback, count(*) FILTER (toxic = 1) AS flagged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "stage_metrics": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, coalesce(round(count(*) FILTER (value > 50) / nullif(count(*) FILTER (value > 50) + count(*) FILTER (value <= 50), 0), 4), 0) AS hit_rate FROM events GROUP BY event_type",
    "error_events": "SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 1 ELSE 2 END::INT AS kind_rank FROM events WHERE event_type IN ('signup', 'purchase')",
    "report_crops": "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality <> 1 ORDER BY doc_id LIMIT 200",
    "cache_lookup": f"WITH d AS (SELECT doc_id, lang, {_NORMAL_TEXT} AS k FROM documents), c AS (SELECT k, min(doc_id) AS cached FROM d WHERE lang = 'en' GROUP BY k) SELECT doc_id, cached, cached IS NOT NULL AS hit FROM d LEFT JOIN c USING (k)",
    "scanned_vote": "SELECT conv_id AS doc_id, count(*) AS sampled, count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50) AS sparse, count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50) > count(*) // 2 AS scanned FROM conversations WHERE turn < 5 GROUP BY conv_id",
    "column_layout": "WITH b AS (SELECT l_orderkey AS doc_id, (l_partkey % 500 + l_partkey % 500 + l_quantity) / 2 AS c FROM lineitem), k AS (SELECT doc_id, count(*) FILTER (c < 270) AS \"left\", count(*) FILTER (c > 300 * 1.1::DOUBLE) AS \"right\" FROM b GROUP BY doc_id) SELECT *, CASE WHEN coalesce(\"right\" / nullif(\"left\" + \"right\", 0), 0) > 0.3 THEN 'double' ELSE 'single' END AS layout FROM k",
    "source_kinds": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'epub' ELSE 'E001' END WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'E001' END AS kind, p_partkey % 3 <> 1 AS math_font, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 1 THEN 'visual_pdf' ELSE 'latex_pdf' END AS pdf_kind, CASE WHEN p_partkey % 10 = 0 THEN 'E002' WHEN p_partkey % 3 = 0 THEN 'E003' END AS pdf_error FROM part",
    "crop_boxes": "SELECT p_partkey, CASE WHEN w THEN x0 END AS x0, CASE WHEN w THEN y0 END AS y0, CASE WHEN w THEN x1 END AS x1, CASE WHEN w THEN y1 END AS y1 FROM (SELECT *, x1 - x0 >= 2 AND y1 - y0 >= 2 AS w FROM (SELECT p_partkey, greatest(0, p_size * 2 - 4)::BIGINT AS x0, greatest(0, floor(p_size * 2 * 0.25) - 4)::BIGINT AS y0, least(200, p_size * 6 + 4)::BIGINT AS x1, least(100, floor(p_size * 2 * 0.25) + 4)::BIGINT AS y1 FROM part))",
    "file_guards": "SELECT doc_id, (strlen(text) + 66)::BIGINT AS bytes, strlen(text) + 66 > 300000 AS too_large, 'b' AS dangling, (120 + floor((strlen(text) + 66) * 100 / 1048576 * 12))::BIGINT AS timeout FROM documents",
    "log_progress": "SELECT event_id, event_id AS done, user_id AS total FROM events",
    "stall_gaps": "SELECT user_id, since, until, round(gap_s, 3) AS gap_s FROM (SELECT user_id, lag(ts) OVER w AS since, ts AS until, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap_s > 86400",
    "hourly_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
