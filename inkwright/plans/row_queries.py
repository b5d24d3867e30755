"""Queries on parsed pages, filters, retries, images and the small tables of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gate as G
from ..operators import markup as M
from ..operators import ordered as O
from ..operators import relational as R
from ..sources import epub as E
from ..sources import formats as S
from ..sources import parsed_pages as P
from ..streaming import logs
from .latex_queries import dealt

_span = lambda kind, text, **more: {"type": kind, "content": text, **more}
_lines = lambda *spans: [{"spans": list(spans)}]
_text = lambda index, *spans, kind="text": {"type": kind, "index": index, "lines": _lines(*spans)}
#: A parsed page; # is a number.
PARSED = {"pdf_info": [{"page_idx": 2, "page_size": [100, 200], "para_blocks": [
    _text(0, _span("text", "Head #"), kind="title"),
    _text(1, _span("text", "let "), _span("inline_equation", "x_{#}"), _span("text", "be"), _span("inline_equation", "\\frac{#}{2}")),
    _text(2, _span("interline_equation", "a=b \\tag{#}"), kind="interline_equation"),
    {"type": "list", "index": 3, "blocks": [_text(0, _span("text", "item #")), _text(1, _span("text", " "))]},
    {"type": "image", "index": 4, "blocks": [_text(0, _span("image", "alt  of #"), kind="image_body"), _text(1, _span("text", "caption"), kind="image_caption")]},
    _text(5, _span("text", "| a | b |\n|---|---|\n| # | 2 |")),
    {"type": "table", "index": 6, "blocks": [_text(0, _span("table", "cells", html="<table><tr><td>#</td></tr></table>"), kind="table_body")]},
], "discarded_blocks": [_text(0, _span("text", "^ {#}"), _span("text", "a note"), kind="page_footnote"), _text(1, _span("text", "page 3"), kind="header")]}]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    """A parse for each customer, in the folder of the batch that begins at page 10."""
    c = dealt(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    text = F.replace(F.lit(json.dumps(PARSED)), F.lit("#"), F.col("c_custkey").cast("string"))
    raw = c.select(F.concat(F.lit("out/"), "c_custkey", F.lit("/batch_00010_00019/x_middle.json")).alias("file"), F.from_json(text, P.SCHEMA).alias("j"))
    return P.rebase(raw.select("file", "j.pdf_info"))


def parsed_text(spark, sf_dir):
    return P.text_rows(P.flat_blocks(_pages(spark, sf_dir)))


def parsed_figures(spark, sf_dir):
    return P.figure_rows(P.flat_blocks(_pages(spark, sf_dir)))


def parsed_equations(spark, sf_dir):
    return P.equation_rows(P.flat_blocks(_pages(spark, sf_dir)))


def parsed_notes(spark, sf_dir):
    return P.footnote_rows(_pages(spark, sf_dir))


def parsed_book(spark, sf_dir):
    """From nested JSON to the markup of each row, in reading order."""
    blocks = P.flat_blocks(_pages(spark, sf_dir))
    eq = P.equation_rows(blocks)
    html = R.region_html(F.lit("formula"), F.col("formula_class") == "display", F.col("inline_text_repr"), F.lit("<svg/>"), F.lit(False), F.lit(None).cast("string"), F.lit(False), F.col("region_id"), F.col("equation_number"))
    regions = eq.select("file", F.col("region_id").alias("region"), html.alias("html"), (F.col("formula_class") == "display").alias("display"))
    rows = P.text_rows(blocks)
    display = eq.filter("formula_class = 'display'").select("file", "page", F.lit("text").alias("kind"), "reading_order", T.placeholder(F.col("region_id")).alias("text"))
    both = rows.unionByName(display)
    # one file stands for all here: a region's id is unique in its book
    keyed = both.withColumn("text", F.regexp_replace("text", r"\[\[EQ:(\w+)\]\]", F.concat(F.lit("[[EQ:$1_"), F.regexp_extract("file", r"(\d+)", 1), F.lit("]]"))))
    keys = regions.withColumn("region", F.concat_ws("_", "region", F.regexp_extract("file", r"(\d+)", 1))).drop("file")
    return R.render_placeholders(keyed, keys, ["file", "reading_order"], "text")


_F = "'out/' || c_custkey || '/batch_00010_00019/x_middle.json' AS file"
_PIPE = "'<table><tr><th>a</th><th>b</th></tr><tr><td>' || c_custkey || '</td><td>2</td></tr></table>'"


def _union(*selects: str) -> str:
    return " UNION ALL ".join(f"SELECT {_F}, {s} FROM customer" for s in selects)


def snapshot_round_trip(spark, sf_dir):
    """Snapshots of customers' orders, written as JSON and read again; the strings' order puts 10 before 2."""
    o = _table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", (F.col("o_orderkey") % 3).cast("int").alias("page"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 2).cast("double")).alias("order"), F.concat(F.lit("eq_"), "o_orderkey").alias("region_id"), F.lit("inline").alias("class"), F.concat(F.lit('"x" \\_{'), "o_orderkey", F.lit("}")).alias("raw_latex"), (F.col("o_orderkey") % 7 == 0).alias("render_as_text"))
    got = P.snapshot_rows(P.snapshot_json(rows, "o_custkey"), "value", "o_custkey")
    return got.select("o_custkey", "seq", "page", F.col("`order`").alias("place"), "region_id", "class", "raw_latex", "render_as_text")


def snapshot_header(spark, sf_dir):
    """Version and counts of the same snapshots."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("page"), F.lit(0.0).alias("order"), F.col("o_orderkey").cast("string").alias("region_id"), F.when(F.col("o_orderkey") % 2 == 0, "display").otherwise("inline").alias("class"), (F.col("o_orderkey") % 7 == 0).alias("deduped"))
    return P.snapshot_json(o, "o_custkey").select("o_custkey", F.from_json("value", P.SNAPSHOT).alias("s")).select("o_custkey", "s.version", "s.counts.*")


def _items(spark, sf_dir):
    """Order lines as equations of a book: text, labels and duplicates by the keys."""
    row = F.col
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.when(row("l_suppkey") % 2 == 0, "MATHML:").otherwise(""), row("l_partkey") % 3).alias("latex"), (row("l_partkey") % 7 == 0).alias("render_as_text"), F.when(row("l_suppkey") % 9 == 0, "label").otherwise("formula").alias("kind"))


def mathml_dedup(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("region", F.format_string("%d_%d", "l_orderkey", "l_linenumber"))
    return R.mark_mathml_duplicates(rows, "latex", ["l_linenumber"], "region", ["l_orderkey"]).select("region", "canonical")


def eligible_rows(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("region", F.format_string("%d_%d", "l_orderkey", "l_linenumber"))
    marked = R.mark_mathml_duplicates(rows, "latex", ["l_linenumber"], "region", ["l_orderkey"])
    return marked.filter(G.eligible(F.col("render_as_text"), F.col("kind"), F.col("canonical"))).select("region")


_MARKED = "(SELECT *, CASE WHEN m THEN nullif(first_value(region) OVER (PARTITION BY l_orderkey, m, latex ORDER BY l_linenumber), region) END AS canonical FROM (SELECT l_orderkey, l_linenumber, l_orderkey || '_' || l_linenumber AS region, l_suppkey % 2 = 0 AS m, l_partkey % 3 AS latex, l_partkey % 7 = 0 AS render_as_text, l_suppkey % 9 = 0 AS label FROM lineitem))"


def retry_outcomes(spark, sf_dir):
    """Failures compiled once more, drawings tried once more, and postprocessing that failed."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("pass", "repair", "fallback"))), (F.col("o_orderkey") % 3).cast("int")).alias("gate"), F.when(F.col("o_orderkey") % 3 == 2, F.get(F.array(*map(F.lit, ("E501", "E502", "E503.plausibility"))), (F.col("o_custkey") % 3).cast("int"))).alias("error_code"), (F.col("o_custkey") % 2 == 0).alias("again"), F.when(F.col("o_custkey") % 5 != 0, "<svg/>").alias("svg"))
    rows = G.retry_outcome(rows, "again")
    rows = G.draw_retry(rows.withColumn("draw_error", F.when(F.col("svg").isNull(), "E601")), F.when(F.col("o_orderkey") % 4 == 0, "<svg>2</svg>"))
    return G.postprocess_outcome(rows.withColumn("done", F.when(F.col("o_orderkey") % 10 != 0, F.concat("svg", F.lit("!")))), "svg", "done").select("o_orderkey", "gate", "error_code", "draw_error", "svg", "done", "post_error")


_RETRY = """WITH a AS (SELECT o_orderkey, o_custkey % 2 = 0 AS again, ['pass', 'repair', 'fallback'][o_orderkey % 3 + 1] AS g, CASE WHEN o_orderkey % 3 = 2 THEN ['E501', 'E502', 'E503.plausibility'][o_custkey % 3 + 1] END AS e, CASE WHEN o_custkey % 5 <> 0 THEN '<svg/>' END AS s FROM orders),
b AS (SELECT *, CASE WHEN g = 'fallback' AND again THEN 'pass' ELSE g END AS g2, CASE WHEN g = 'fallback' AND again AND e IN ('E501', 'E502') THEN NULL ELSE e END AS e2, s IS NULL AND o_orderkey % 4 = 0 AS redrawn FROM a),
c AS (SELECT *, CASE WHEN redrawn THEN '<svg>2</svg>' ELSE s END AS s2 FROM b)
SELECT o_orderkey, CASE WHEN redrawn THEN 'pass' WHEN s IS NULL THEN 'fallback' ELSE g2 END AS gate, e2 AS error_code, CASE WHEN s2 IS NULL THEN 'E601' END AS draw_error, s2 AS svg, CASE WHEN o_orderkey % 10 = 0 THEN s2 ELSE s2 || '!' END AS done, CASE WHEN s2 IS NOT NULL AND o_orderkey % 10 = 0 THEN 'E701' END AS post_error FROM c"""


def volume_images(spark, sf_dir):
    """The images that the chapters of each volume show."""
    o = _table(spark, sf_dir, "orders")
    chapters = o.select((F.col("o_orderkey") % 20).alias("volume"), F.concat(F.lit('<p><img src="../images/c'), "o_custkey", F.lit('.png"/><img src="../images/none.png"/></p>')).alias("xhtml"))
    images = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("image"))
    return O.images_of_volumes(chapters, images, ["volume"])


def svg_totals(spark, sf_dir):
    """Drawings of each chapter, volume and book."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("book"), (F.col("l_partkey") % 3).alias("volume"), F.col("l_linenumber").alias("chapter"), F.repeat(F.lit("<svg/>"), F.col("l_quantity").cast("int") % 4).alias("xhtml"))
    return O.drawing_totals(rows, "book", "volume", "chapter")


def reuse_count(spark, sf_dir):
    """Requests whose artefact is there for the same string, and how many."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("id"), (F.col("o_custkey") % 3).alias("latex"))
    made = o.filter("o_orderkey < 100").select("id", "latex").distinct().withColumn("artefact", F.lit("x"))
    return R.with_lookup(o, made, "id", "latex").groupBy("hit").agg(F.count("*").alias("n"))


def cli_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("a"), (F.col("c_custkey") % 9).alias("b"))
    return rows.select("c_custkey", R.percentage(F.col("a"), F.col("b")).alias("share"), R.duration(F.col("c_custkey") * 7919).alias("took"))


def small_rules(spark, sf_dir):
    """Crops, device memory, table tags, checker lines, resolved links and stems of parts."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, ("ERROR(x): a", "WARNING ERROR b", "FATAL c"))), (F.col("p_partkey") % 3).cast("int")).alias("line"), F.concat(F.lit("<table><tr><td><font>"), "p_size", F.lit("</font><script/></td></tr></table>")).alias("t"), F.get(F.array(*map(F.lit, ("../img/a.png", "b.png#x", "https://c/d.png", "data:e"))), (F.col("p_partkey") % 4).cast("int")).alias("src"))
    errors = E.checker_errors(p).select("p_partkey", F.lit(True).alias("checker_error"))
    out = p.join(errors, "p_partkey", "left")
    return out.select("p_partkey", G.crop_too_small(F.col("p_size"), F.col("p_size") - 10).alias("small"), S.memory_ladder(F.lit(20.0), F.col("p_size") * 0.5).alias("rung"), F.array_join(T.unknown_table_tags(F.col("t")), ",").alias("tags"), F.coalesce("checker_error", F.lit(False)).alias("checker_error"), E.resolved(F.lit("OEBPS/text/c.xhtml"), F.col("src")).alias("path"), M.title_or_stem(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<h1>T "), "p_size", F.lit("</h1>"))).otherwise("<p/>"), F.concat(F.lit("/in/book_"), "p_partkey", F.lit(".html"))).alias("title"))


def page_numbers(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber")
    return O.number_within(rows, ["page"], ["l_linenumber"], "eq").select("page", "l_linenumber", "id")


def font_votes(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("page"), F.when(F.col("l_suppkey") % 6 == 0, "CMSY10").otherwise("Times").alias("font"))
    return S.has_math_fonts(rows)


def pending_batches(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), "c_custkey").alias("dir"))
    have = _table(spark, sf_dir, "orders").select(F.concat(F.lit("b"), "o_custkey").alias("dir")).distinct()
    return P.pending(c, have, False)


def preferred_parse(spark, sf_dir):
    files = _table(spark, sf_dir, "customer").select(F.concat(F.lit("p/"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") == 5, "/doc_middle.json").when(F.col("c_custkey") % 2 == 0, "/a_middle.json").otherwise("/a.json")).alias("path"))
    return P.preferred(files, "doc")


def run_log(spark, sf_dir):
    """The records of runs, each opened by a run_start."""
    ev = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), "ts", F.col("event_type"), F.col("event_id").cast("string").alias("equation_id"))
    return logs.with_run_start(ev).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "run_start").alias("starts"), F.min("ts").alias("first"))


def run_results(spark, sf_dir):
    """Result records and cache entries as JSON."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.select("doc_id", logs.result_json("doc_id", "source", "n_chars").alias("result"), logs.cache_json(F.concat(F.lit("k"), "doc_id"), F.col("lang"), F.col("n_chars") / 2, F.length("source")).alias("cached"))


def omitted_crops(spark, sf_dir):
    return R.first_with_rest(_table(spark, sf_dir, "documents").filter("n_chars > 500"), ["doc_id"], 200)[1]


QUERIES = {f.__name__: f for f in (parsed_text, parsed_figures, parsed_equations, parsed_notes, parsed_book, snapshot_round_trip, snapshot_header, mathml_dedup, eligible_rows, retry_outcomes, volume_images, svg_totals, reuse_count, cli_summary, small_rules, page_numbers, font_votes, pending_batches, preferred_parse, run_log, run_results, omitted_crops)}
_ID = "c_custkey"
_X = f"'x<sub>' || {_ID} || '</sub>'"
ORACLES = {
    "parsed_text": _union(f"12 AS page, 'heading' AS kind, 0::DOUBLE AS reading_order, 'Head ' || {_ID} AS text", "12, 'text', 1, 'let [[EQ:eq_12_1]] be [[EQ:eq_12_2]]'", f"12, 'list_item', 3, 'item ' || {_ID}", "12, 'text', 4 + 1 / 1024::DOUBLE, 'caption'"),
    "parsed_figures": _union(f"12 AS page, 4::DOUBLE AS reading_order, 'alt of ' || {_ID} AS alt_text, NULL AS table_html", f"12, 5, 'table', {_PIPE}", f"12, 6, 'cells', '<table><tr><td>' || {_ID} || '</td></tr></table>'"),
    "parsed_equations": _union(f"12 AS page, 1::INT AS seq, 1::DOUBLE AS reading_order, 'eq_12_1' AS region_id, 'inline' AS formula_class, 'x_{{' || {_ID} || '}}' AS raw_latex, NULL::VARCHAR AS equation_number, {_X} AS inline_text_repr, true AS render_as_text".replace("{{", "{").replace("}}", "}"), f"12, 2, 1, 'eq_12_2', 'inline', '\\frac{{' || {_ID} || '}}{{2}}', NULL, NULL, false", f"12, 3, 2, 'eq_12_3', 'display', 'a=b', '(' || {_ID} || ')', NULL, false"),
    "parsed_notes": _union(f"12 AS page, 'fn_12_1' AS note_id, {_ID}::VARCHAR AS number, 1000000::DOUBLE AS reading_order, '^ {{' || {_ID} || '}} a note' AS text".replace("{{", "{").replace("}}", "}")),
    "parsed_book": _union(f"0::DOUBLE AS reading_order, '<p>Head ' || {_ID} || '</p>' AS html", f"1, '<p>let <span class=\"eq-text\">' || {_X} || '</span> be <span class=\"eq-inline\"><svg/></span></p>'", f"2, '<div class=\"eq-display\"><span class=\"eq-number\">(' || {_ID} || ')</span><svg/></div>'", f"3, '<p>item ' || {_ID} || '</p>'", "4 + 1 / 1024::DOUBLE, '<p>caption</p>'"),
    "snapshot_round_trip": """SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 ELSE 0 END, 'eq_' || o_orderkey) - 1)::INT AS seq, (o_orderkey % 3)::INT AS page, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 2)::DOUBLE END AS place, 'eq_' || o_orderkey AS region_id, 'inline' AS class, '"x" \\_{' || o_orderkey || '}' AS raw_latex, o_orderkey % 7 = 0 AS render_as_text FROM orders""",
    "snapshot_header": "SELECT o_custkey, 1::INT AS version, count(*) AS equations, count(*) FILTER (o_orderkey % 2 = 0) AS display, count(*) FILTER (o_orderkey % 2 = 1) AS inline, 0::BIGINT AS render_as_text, count(*) FILTER (o_orderkey % 7 = 0) AS deduped, count(DISTINCT o_orderkey % 3) AS pages FROM orders GROUP BY o_custkey",
    "mathml_dedup": f"SELECT region, canonical FROM {_MARKED}",
    "eligible_rows": f"SELECT region FROM {_MARKED} WHERE canonical IS NULL AND NOT render_as_text AND NOT label",
    "retry_outcomes": _RETRY,
    "volume_images": "SELECT DISTINCT o_orderkey % 20 AS volume, 'c' || o_custkey AS image FROM orders JOIN customer ON o_custkey = c_custkey",
    "svg_totals": "SELECT book, volume, chapter, sum(n)::BIGINT AS drawings FROM (SELECT l_suppkey % 5 AS book, l_partkey % 3 AS volume, l_linenumber AS chapter, l_quantity::INT % 4 AS n FROM lineitem) GROUP BY GROUPING SETS ((book), (book, volume), (book, volume, chapter))",
    "reuse_count": "SELECT m.id IS NOT NULL AS hit, count(*) AS n FROM (SELECT o_custkey % 50 AS id, o_custkey % 3 AS latex FROM orders) o LEFT JOIN (SELECT DISTINCT o_custkey % 50 AS id, o_custkey % 3 AS latex FROM orders WHERE o_orderkey < 100) m USING (id, latex) GROUP BY 1",
    "cli_summary": "SELECT c_custkey, printf('%.1f%%', 100.0::DOUBLE * (c_custkey % 7) / greatest(c_custkey % 9, 1)) AS share, printf('%d m %02d s', (c_custkey * 7919 // 1000) // 60, (c_custkey * 7919 // 1000) % 60) AS took FROM customer",
    "small_rules": "SELECT p_partkey, p_size < 20 OR p_size - 10 < 10 AS small, CASE WHEN 14 <= p_size * 0.5 - 0.5 THEN 0.7::DOUBLE WHEN 11 <= p_size * 0.5 - 0.5 THEN 0.55 END AS rung, 'font,script' AS tags, p_partkey % 3 = 0 AS checker_error, CASE p_partkey % 4 WHEN 0 THEN 'OEBPS/img/a.png' WHEN 1 THEN 'OEBPS/text/b.png' END AS path, CASE WHEN p_size % 2 = 0 THEN 'T ' || p_size ELSE 'book_' || p_partkey END AS title FROM part",
    "page_numbers": "SELECT l_orderkey AS page, l_linenumber, 'eq_' || l_orderkey || '_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS id FROM lineitem",
    "font_votes": "SELECT l_orderkey AS doc_id, bool_or(l_suppkey % 6 = 0) AS math_fonts FROM lineitem WHERE l_partkey % 20 < 10 GROUP BY 1",
    "pending_batches": "SELECT 'b' || c_custkey AS dir FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "preferred_parse": "SELECT 'p/000005/doc_middle.json' AS path, 0::INT AS preference",
    "run_log": "SELECT user_id::VARCHAR AS run_id, count(*) + 1 AS n, 1::BIGINT AS starts, min(ts) AS first FROM events GROUP BY user_id",
    "run_results": """SELECT doc_id, '{"document":"' || doc_id || '","source":"' || source || '","pages":' || n_chars || ',"success":true}' AS result, '{"key":"k' || doc_id || '","latex":"' || lang || '","score":' || (n_chars / 2)::DOUBLE || ',"svg_length":' || length(source) || '}' AS cached FROM documents""",
    "omitted_crops": "SELECT greatest(count(*) - 200, 0)::BIGINT AS omitted FROM documents WHERE n_chars > 500",
}
