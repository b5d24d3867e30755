"""Plans that work a table or a text out once, and workers that hold a few pages at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.operators import markup
from inkwright.plans import formula_queries, latex_queries, row_queries
from inkwright.sources import parsed_pages as P

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_table_formulas_read_documents_and_cut_texts_once(spark):
    pages = formula_queries._span_pages(spark, SF)
    assert plan(pages).count("regexp_extract_all") == 1
    figures = plan(P.figure_rows(P.flat_blocks(pages)))
    assert figures.count("Relation [") == 1 and figures.count("regexp_extract_all") == 1


def test_parsed_figures_read_pages_once_over_all_cores(spark):
    found = row_queries.parsed_figures(spark, SF)
    assert plan(found).count("Relation [") == 1 and "RepartitionByExpression" in plan(found)


def test_blocks_and_figures_of_odd_pages(spark):
    block = lambda kind, index, text, blocks=None, html=None: {"type": kind, "index": index, "lines": [{"spans": [{"type": "text", "content": text, "html": html}]}, {"spans": None}], "blocks": blocks}
    inner = [{"type": "table_body", "lines": [{"spans": [{"type": "table", "content": " a  b ", "html": "<table/>"}]}]}, {"type": None, "lines": None}]
    formula = {"type": "text", "index": 4.0, "lines": [{"spans": [{"type": "inline_equation", "content": "| a |\n|---|\n| 1 |"}]}]}
    page = {"page_idx": 1, "para_blocks": [block("text", 1.0, "| a | b |\n|---|---|\n| 1 |"), block("text", None, "no table"), block("table", 3.0, "x", inner), formula, block("image_body", 5.0, None, [])]}
    raw = spark.createDataFrame([("f", [page])], f"file string, {P.SCHEMA}".replace("pdf_info array", "pdf_info: array").replace("file string", "file: string"))
    blocks = P.flat_blocks(P.rebase(raw))
    got = [(r.type, r.parent, r.reading_order) for r in blocks.orderBy("reading_order", F.desc("type")).collect()]
    assert got == [("text", None, 1.0), ("text", None, 1.0), ("table_body", "table", 3.0), (None, "table", 3.0 + 1 / 1024), ("text", None, 4.0), ("image_body", None, 5.0)]
    figures = [tuple(r) for r in P.figure_rows(blocks).orderBy("reading_order").collect()]
    pipe = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr></table>"
    assert figures == [("f", 1, 1.0, "table", pipe), ("f", 1, 3.0, "a b", "<table/>"), ("f", 1, 5.0, "", None)]


def test_a_link_is_cut_once(spark):
    found = plan(spark.createDataFrame([("x",)], "t string").select(T.linkify(F.col("t")).alias("h")))
    assert found.count("aggregate(") == 1 and found.count("regexp_extract_all") == 1
    assert "RepartitionByExpression" in plan(latex_queries.QUERIES["linkify"](spark, SF))


def test_links_with_long_tails(spark):
    cases = {"https://a.org/x)" + ").,]" * 40: "https://a.org/x", "http://a.org/(b)))": "http://a.org/(b)", "http://a.org/b.)?!": "http://a.org/b", "http://a.org/b_(c).": "http://a.org/b_(c)"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.linkify(F.col("t")).alias("h"), T.trim_url(F.col("t")).alias("u")).collect()
    for r in rows:
        u = cases[r.t]
        assert r.u == u and r.h == f'<a href="{u}">{u}</a>{r.t[len(u):]}'
    assert spark.createDataFrame([(None,)], "t string").select(T.linkify(F.col("t")), T.is_pipe_table(F.col("t")), T.pipe_table_html(F.col("t"))).first() == (None, None, None)


def test_rows_of_pages_leave_a_worker_in_small_batches():
    n = 5 * markup.WALK_PAGES + 1
    one = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i == 7 else f"<html><body><p>a {i}</p><p>b</p></body></html>" for i in range(n)])], ["page_id", "html"])
    got = list(markup.walked_batches(iter([one, one.slice(0, 0)]), "page_id"))
    assert len(got) == 6 and max(len(set(b.column(0).to_pylist())) for b in got) <= markup.WALK_PAGES
    assert [k for b in got for k in b.column(0).to_pylist()] == [i for i in range(n) if i != 7 for _ in range(2)]
