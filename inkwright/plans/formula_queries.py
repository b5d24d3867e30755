"""Queries on formulas in tables, over spans of documents and names in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions import tex_structure as X
from ..functions import text as T
from ..functions.strings import let
from ..operators import gate as G
from ..operators import markup as M
from ..sources import parsed_pages as P
from .latex_queries import _score_sql, quoted
from .table_queries import _SPAN_ROWS, _SPANS, spans

#: Formulas of a table and of its rows, in the tables made of a document's spans.
A_TABLE, A_ROW = 12, 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_pages(spark, sf_dir) -> DataFrame:
    """A parsed page a document, its formula spans in the cells of tables, through the parser's JSON."""
    docs = _table(spark, sf_dir, "documents")
    cells = F.transform(T.delimiters(F.col("text")), lambda s: F.concat(F.lit("<td>"), F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit("</td>")))
    cut = lambda a, n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda i: F.slice(a, i * n + 1, F.lit(n)))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(r, ""), F.lit("</tr>"))
    table = lambda t: F.concat(F.lit("<table>"), F.array_join(F.transform(cut(t, A_ROW), row), ""), F.lit("</table>"))
    rows = docs.filter(F.col("text").rlike(T.DELIMITED))
    span = lambda html: F.struct(F.lit("table").alias("type"), F.lit("cells").alias("content"), html.alias("html"))
    lines = lambda html: F.array(F.struct(F.array(span(html)).alias("spans")))
    body = lambda html: F.struct(F.lit("table_body").alias("type"), lines(html).alias("lines"))
    blocks = let(cells, lambda c: F.transform(cut(c, A_TABLE), lambda t, i: F.struct(F.lit("table").alias("type"), i.cast("double").alias("index"), F.array(body(table(t))).alias("blocks"))))
    page = F.struct(F.col("doc_id").cast("int").alias("page_idx"), blocks.alias("para_blocks"))
    raw = rows.select(F.lit("x_middle.json").alias("file"), F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("j"))
    return P.rebase(raw.select("file", F.from_json("j", P.SCHEMA).alias("j")).select("file", "j.pdf_info"))


def table_cell_formulas(spark, sf_dir):
    """Tables of parsed pages with placeholders, and a row for each formula in their cells."""
    figures = P.figure_rows(P.flat_blocks(_span_pages(spark, sf_dir))).withColumn("stem", F.concat_ws("_", F.lit("eq"), "page"))
    found = table_functions.formulas_in_tables(figures, "table_html", "stem", ["file", "page"], ["reading_order"])
    return found.select("page", "reading_order", "row_kind", "html", "formula", "cell_row", "cell_col", "region_id", "latex")


def table_formulas_sql(spark, sf_dir):
    """The same through the table function in SQL: formulas and tables of each page."""
    table_functions.register(spark)
    P.figure_rows(P.flat_blocks(_span_pages(spark, sf_dir))).withColumn("stem", F.concat_ws("_", F.lit("eq"), "page")).createOrReplaceTempView("parsed_tables")
    return spark.sql(
        "SELECT page, count_if(row_kind = 'formula') AS formulas, count_if(row_kind = 'table') AS tables, max(cell_row) AS most_rows, sum(length(latex)) AS chars "
        "FROM table_formulas(TABLE(parsed_tables) PARTITION BY (file, page) ORDER BY (reading_order), html => 'table_html', prefix => 'stem') GROUP BY page")


def walked_table_formulas(spark, sf_dir):
    """Pages whose navigation stands in a table, and its first name in a pipe table: figures and formulas."""
    names = F.filter(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), lambda s: F.regexp_replace(s, "[^A-Za-z]", "")), lambda s: s != "")
    rows = F.array_join(F.transform(names, lambda s: F.concat(F.lit("<tr><td>\\alpha_{"), s, F.lit("}</td><td>plain</td></tr>"))), "")
    piped = F.concat(F.lit("<p>| n | f |\n|---|---|\n| 1 | \\alpha_{"), F.coalesce(F.get(names, F.lit(0)), F.lit("x")), F.lit("} |</p>"))
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<html><body><table><tr><th>t</th></tr>"), rows, F.lit("</table>"), piped, F.lit("</body></html>")).alias("html"))
    found = M.walked_tables(M.walk_pages(pages))
    return found.select("page_id", "row", "id", "formula_class", "text", "seq", "html")


#: What spans of documents are put into, in turn; ~ is the span.
FRAMES = ("~", r"\frac{~}{b}", "{~", "x^{~}^2", r"\left( ~ \right)_1", r"\left[ ~", r"\begin{array}{c} ~ \end{array}", r"\begin{matrix} ~ \end{array}", r"\sqrt[~]{a}_b^c", "a_~_b", r"\vec", "~}")


def _framed(spark, sf_dir) -> DataFrame:
    frame = F.get(F.array(*map(F.lit, FRAMES)), F.pmod(F.col("doc_id") + F.col("pos"), F.lit(len(FRAMES))).cast("int"))
    return spans(spark, sf_dir).select("doc_id", "pos", F.replace(frame, F.lit("~"), F.col("latex")).alias("x"))


def structure_errors(spark, sf_dir):
    """The first fault of every span of documents, each put into a frame."""
    return _framed(spark, sf_dir).select("doc_id", "pos", X.structure_error(F.col("x")).alias("fault"))


#: Formulas that a repair makes right, and one that none does; ~ is the letters of a span.
BROKEN = (r"\In ~ d x", r"\Eta + w_{1}", r"~^{2} + \Nu", r"\wrong ~", r"\frac{~}{2}")


def accepted_repairs(spark, sf_dir):
    """Gates of formulas over the letters of spans, checked by structure, with the repairs that were kept."""
    letters = F.regexp_replace("latex", "[^A-Za-z]", "")
    frame = F.get(F.array(*map(F.lit, BROKEN)), F.pmod(F.col("doc_id") + F.col("pos"), F.lit(len(BROKEN))).cast("int"))
    rows = spans(spark, sf_dir).select("doc_id", "pos", F.replace(frame, F.lit("~"), letters).alias("x"))
    found = G.validate(rows, "x", F.lit(False), X.compiles)
    return found.select("doc_id", "pos", "normalized", F.round("score", 6).alias("score"), "gate", "repair_attempts", "error_code")


QUERIES = {f.__name__: f for f in (table_cell_formulas, table_formulas_sql, walked_table_formulas, structure_errors, accepted_repairs)}
_FORMULAS = f"(SELECT doc_id, pos, trim(CASE WHEN starts_with(span, '$$') OR starts_with(span, '\\') THEN span[3:-3] ELSE span[2:-2] END, ' ' || chr(9) || chr(10) || chr(13)) AS latex FROM (SELECT doc_id, pos, replace(span, '<', '&lt;') AS span FROM {_SPANS}))"
_NAMES = """(SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda s: regexp_replace(s, '[^A-Za-z]', '', 'g')), lambda s: s <> '') AS names FROM pages)"""
ORACLES = {
    "table_cell_formulas": f"""
WITH f AS (SELECT doc_id::INT AS page, pos // {A_TABLE} AS t, pos, 'eq_' || doc_id || '_t' || (pos + 1) AS region_id, latex FROM {_FORMULAS}),
r AS (SELECT page, t, pos // {A_ROW} AS r, '<tr>' || string_agg('<td>[[EQ:' || region_id || ']]</td>', '' ORDER BY pos) || '</tr>' AS h FROM f GROUP BY ALL)
SELECT page, t::DOUBLE AS reading_order, 'table' AS row_kind, '<table>' || string_agg(h, '' ORDER BY r) || '</table>' AS html, NULL::INT AS formula, NULL::INT AS cell_row, NULL::INT AS cell_col, NULL::VARCHAR AS region_id, NULL::VARCHAR AS latex FROM r GROUP BY page, t
UNION ALL SELECT page, t::DOUBLE, 'formula', NULL, pos + 1, (pos % {A_TABLE}) // {A_ROW} + 1, pos % {A_ROW} + 1, region_id, latex FROM f""",
    "table_formulas_sql": f"SELECT doc_id::INT AS page, count(*) AS formulas, count(DISTINCT pos // {A_TABLE}) AS tables, (max((pos % {A_TABLE}) // {A_ROW}) + 1)::INT AS most_rows, sum(length(latex))::BIGINT AS chars FROM {_FORMULAS} GROUP BY doc_id",
    "walked_table_formulas": f"""
WITH n AS (SELECT page_id, names, coalesce(names[1], 'x') AS one FROM {_NAMES}), e AS (SELECT page_id, unnest(names) AS s, generate_subscripts(names, 1) AS i FROM n)
SELECT page_id, 'figure' AS row, 'fig_' || page_id || '_1' AS id, NULL::VARCHAR AS formula_class, 'table' AS text, 1::INT AS seq, '<table><tr><th>t</th></tr>' || array_to_string(list_transform(names, lambda s, i: '<tr><td>[[EQ:eq_' || page_id || '_t' || i || ']]</td><td>plain</td></tr>'), '') || '</table>' AS html FROM n
UNION ALL SELECT page_id, 'figure', 'tb_' || page_id || '_1', NULL, 'table', 2, '<table><tr><th>n</th><th>f</th></tr><tr><td>1</td><td>[[EQ:eq_' || page_id || '_t' || (len(names) + 1) || ']]</td></tr></table>' FROM n
UNION ALL SELECT page_id, 'equation', 'eq_' || page_id || '_t' || i, 'inline', '\\alpha_{{' || s || '}}', 1, NULL FROM e
UNION ALL SELECT page_id, 'equation', 'eq_' || page_id || '_t' || (len(names) + 1), 'inline', '\\alpha_{{' || one || '}}', 2, NULL FROM n""",
}

_LIST = lambda items: "[" + ", ".join(map(quoted, items)) + "]"
_FRAME = lambda frames, text: f"replace({_LIST(frames)}[(doc_id + pos) % {len(frames)} + 1], '~', {text})"
_TAKES = "CASE " + " ".join(f"WHEN c = {quoted(k)}" + (" OR starts_with(c, '\\sqrt')" if k == r"\sqrt" else "") + f" THEN {v}" for k, v in X.ARGUMENTS.items()) + " ELSE 0 END"
ORACLES["structure_errors"] = rf"""
WITH RECURSIVE f AS (SELECT doc_id, pos, {_FRAME(FRAMES, "latex")} AS x FROM {_SPAN_ROWS}),
s AS (SELECT doc_id, pos, regexp_extract_all(x, {quoted(X.TOKEN)}) AS t, 0 AS i, []::STRUCT(kind VARCHAR, pending VARCHAR, flags VARCHAR, need INT)[] AS st, '' AS p, '' AS fl, 0 AS n, false AS d, NULL::VARCHAR AS e FROM f
UNION ALL SELECT doc_id, pos, t, i + 1,
 CASE WHEN a = 'push' THEN list_append(st, {{'kind': CASE WHEN c = '{{' THEN c WHEN c = '\left' THEN 'L' ELSE 'E' || name END, 'pending': p, 'flags': fl, 'need': n}}) WHEN a = 'pop' THEN st[:-2] ELSE st END,
 CASE WHEN a = 'push' THEN '' WHEN a = 'script' THEN c WHEN a IN ('pop', 'atom') AND n0 <= 1 THEN '' ELSE p0 END,
 CASE WHEN a IN ('push', 'clear') THEN '' WHEN a = 'script' THEN fl || c WHEN a IN ('pop', 'atom') AND n0 <= 1 AND p0 = '' THEN '' ELSE f0 END,
 CASE WHEN a = 'push' THEN 0 WHEN a = 'need' THEN greatest(n - 1, 0) + takes WHEN a IN ('pop', 'atom') THEN greatest(n0 - 1, 0) ELSE n END,
 a <> 'delim' AND (c IN ('\left', '\right') AND a IN ('push', 'pop')),
 CASE WHEN a[1] = '!' THEN a[2:] END
FROM (SELECT *, CASE WHEN a = 'pop' THEN l.pending ELSE p END AS p0, CASE WHEN a = 'pop' THEN l.flags ELSE fl END AS f0, CASE WHEN a = 'pop' THEN l.need ELSE n END AS n0 FROM (SELECT *, CASE
  WHEN d THEN CASE WHEN c IN ('{{', '}}') THEN '!missing_delimiter' ELSE 'delim' END
  WHEN (c IN ('}}', '&', '\right', '\\', '^', '_') OR ends) AND (p <> '' OR n > 0) THEN '!missing_argument'
  WHEN c = '{{' OR c = '\left' OR begins THEN 'push'
  WHEN c = '}}' THEN CASE WHEN top = '{{' THEN 'pop' WHEN top = '' THEN '!extra_close' WHEN top = 'L' THEN '!unclosed_left' ELSE '!unclosed_environment' END
  WHEN c = '\right' THEN CASE WHEN top = 'L' THEN 'pop' ELSE '!extra_right' END
  WHEN ends THEN CASE WHEN top = 'E' || name THEN 'pop' ELSE '!mismatched_end' END
  WHEN c IN ('^', '_') THEN CASE WHEN contains(fl, c) THEN CASE WHEN c = '^' THEN '!double_superscript' ELSE '!double_subscript' END ELSE 'script' END
  WHEN c = '&' THEN CASE WHEN starts_with(top, 'E') THEN 'clear' ELSE '!misplaced_alignment' END
  WHEN c = '\\' THEN 'clear' WHEN c = '$' THEN '!math_shift' WHEN c = '#' THEN '!parameter_char' WHEN c = '\' THEN '!lone_backslash'
  WHEN list_contains({_LIST(X.PASSED)}, c) THEN 'none' WHEN takes > 0 THEN 'need' ELSE 'atom' END AS a
 FROM (SELECT *, coalesce(l.kind, '') AS top, starts_with(c, '\begin') AND name <> '' AS begins, starts_with(c, '\end') AND name <> '' AS ends, {_TAKES} AS takes
  FROM (SELECT *, t[i + 1] AS c, st[-1] AS l, regexp_extract(t[i + 1], '\{{(.*)\}}', 1) AS name FROM s WHERE i < len(t) AND e IS NULL))))),
z AS (SELECT doc_id, pos, e, d, p, n, coalesce(st[-1].kind, '') AS top FROM s WHERE e IS NOT NULL OR i = len(t))
SELECT doc_id, pos, CASE WHEN e IS NOT NULL THEN e WHEN d THEN 'missing_delimiter' WHEN p <> '' OR n > 0 THEN 'missing_argument' WHEN top = '{{' THEN 'unclosed_group' WHEN top = 'L' THEN 'unclosed_left' WHEN top <> '' THEN 'unclosed_environment' END AS fault FROM z"""
ORACLES["accepted_repairs"] = rf"""
WITH f AS (SELECT doc_id, pos, (doc_id + pos) % {len(BROKEN)} AS k, regexp_replace(latex, '[^A-Za-z]', '', 'g') AS w FROM {_SPAN_ROWS}),
g AS (SELECT doc_id, pos, k, regexp_replace(trim(replace(['\In ~ d x', '\Eta + w_{{1}}', '~^{{2}} + \Nu', '\wrong ~', '\frac{{~}}{{2}}'][k + 1], '~', w)), ' +', ' ', 'g') AS before,
 regexp_replace(trim(replace(['\int ~ d x', '\eta + w_{{1}}', '~^{{2}} + \nu', '\wrong ~', '\frac{{~}}{{2}}'][k + 1], '~', w)), ' +', ' ', 'g') AS after FROM f),
h AS (SELECT *, {_score_sql('after', 'false')} AS good, {_score_sql('before', 'false')} AS bad FROM g),
j AS (SELECT *, k <> 3 AND good >= 0.4 - 1e-12 AS kept FROM h)
SELECT doc_id, pos, CASE WHEN kept THEN after ELSE before END AS normalized, round(CASE WHEN kept THEN good ELSE bad END, 6) AS score, CASE WHEN NOT kept THEN 'fallback' WHEN good >= 0.65 - 1e-12 THEN 'pass' ELSE 'repair' END AS gate,
 CASE WHEN kept AND k < 3 THEN 1 ELSE 0 END::INT AS repair_attempts, CASE WHEN NOT kept THEN CASE WHEN k = 4 THEN 'E503.plausibility' ELSE 'E501' END WHEN good < 0.65 - 1e-12 THEN 'E503.plausibility' END AS error_code FROM j"""
