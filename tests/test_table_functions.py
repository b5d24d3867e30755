"""Formulas in table cells as rows."""

import pytest
from pyspark.sql import functions as F

from inkwright.functions import table_functions as TF
from inkwright.operators import markup, mathml
from inkwright.sources import parsed_pages

ROWS = [
    ("a", 1, 0, r"<table><tr><td>$x$ and \(y\)</td><td>plain</td></tr><tr><td>\eta_{1}</td><TD>the value of x_{2} is here</TD></tr></table>", "eq_1"),
    ("a", 1, 1, "<table><tr><td>nothing here</td></tr></table>", "eq_1"),
    ("a", 1, 2, "<table><tr><td><b>a_1</b></td><td>[[EQ:eq_9]] $z$</td></tr></table>", "eq_1"),
    ("a", 2, 0, "<table><tr><th>$q$</th></tr></table>", None),
    ("b", 1, 0, None, "eq_1"),
]
SCHEMA = "doc string, page int, seq int, body string, stem string"


def found(df):
    return sorted((r.doc, r.page, r.seq, r.formula, r.cell_row, r.cell_col, r.region_id, r.latex) for r in df.filter("row_kind = 'formula'").collect())


WANT = [
    ("a", 1, 0, 1, 1, 1, "eq_1_t1", "x"), ("a", 1, 0, 2, 1, 1, "eq_1_t2", "y"), ("a", 1, 0, 3, 2, 1, "eq_1_t3", r"\eta_{1}"), ("a", 1, 0, 4, 2, 2, "eq_1_t4", "x_{2}"),
    ("a", 1, 2, 5, 1, 2, "eq_1_t5", "z"), ("a", 2, 0, 1, 1, 1, "t1", "q"),
]


def test_rows_of_a_partition(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = TF.formulas_in_tables(df, "body", "stem", ["doc", "page"], ["seq"])
    assert found(got) == WANT
    tables = {(r.doc, r.page, r.seq): r.html for r in got.filter("row_kind = 'table'").collect()}
    assert tables["a", 1, 2] == "<table><tr><td><b>a_1</b></td><td>[[EQ:eq_9]] [[EQ:eq_1_t5]]</td></tr></table>"
    assert tables["a", 1, 1] == ROWS[1][3] and tables["b", 1, 0] is None and len(tables) == 5
    assert TF.formulas_in_tables(df.limit(0), "body", "stem", ["doc", "page"], ["seq"]).count() == 0


def test_in_sql(spark):
    TF.register(spark)
    spark.createDataFrame(ROWS, SCHEMA).createOrReplaceTempView("some_tables")
    call = "SELECT * FROM table_formulas(TABLE(some_tables) PARTITION BY (doc, page) ORDER BY seq, html => 'body', prefix => 'stem')"
    assert found(spark.sql(call)) == WANT
    for bad in (call.replace("'body'", "'nobody'"), call.replace("TABLE(some_tables)", "TABLE(SELECT *, 1 AS latex FROM some_tables)")):
        with pytest.raises(Exception, match="table_formulas"):
            spark.sql(bad).collect()


def test_python_sees_no_plain_table(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = TF.formulas_in_tables(df, "body", "stem", ["doc", "page"], ["seq"])._jdf.queryExecution().optimizedPlan().toString()
    before = plan.split("Generate")[-1] if "EvalPythonUDTF" not in plan else plan.split("EvalPythonUDTF")[-1]
    assert "RLIKE" in before and "UNION" in plan.upper()


def test_numbers_agree_with_the_column_form(spark):
    html = ROWS[0][3]
    shown, latex = mathml.table_formulas(html, "p")
    assert latex == ["x", "y", r"\eta_{1}", "x_{2}"] and shown.count("[[EQ:p_") == 4


def test_parsed_and_walked_tables(spark):
    figures = spark.createDataFrame([("f", 3, 0.0, "alt", "<table><tr><td>$a$</td></tr></table>"), ("f", 3, 1.0, "alt", "<table><tr><td>x_{1}</td></tr></table>"), ("f", 3, 2.0, "picture", None)], "file string, page int, reading_order double, alt_text string, table_html string")
    shown, formulas = parsed_pages.tables_and_formulas(figures)
    assert sorted((r.reading_order, r.table_html) for r in shown.collect() if r.table_html) == [(0.0, "<table><tr><td>[[EQ:eq_3_t1]]</td></tr></table>"), (1.0, "<table><tr><td>[[EQ:eq_3_t2]]</td></tr></table>")]
    assert shown.count() == 3
    assert sorted((r.seq, r.region_id, r.raw_latex, r.formula_class, r.inline_text_repr) for r in formulas.collect()) == [(1, "eq_3_t1", "a", "inline", "a"), (2, "eq_3_t2", "x_{1}", "inline", "x<sub>1</sub>")]
    page = "<html><body><p>| a | b |\n|--|--|\n| $u$ | v_{3} |</p><p>text | with $w$</p><img src='p.png'/></body></html>"
    walked = markup.walked_tables(markup.walk_pages(spark.createDataFrame([(7, page)], "page_id long, html string"))).collect()
    assert sorted(((r.row, r.id, r.text, r.html) for r in walked), key=repr) == sorted([
        ("equation", "eq_7_1", "u", None), ("equation", "eq_7_2", "w", None), ("equation", "eq_7_t1", "v_{3}", None),
        ("figure", "tb_7_1", "table", "<table><tr><th>a</th><th>b</th></tr><tr><td>[[EQ:eq_7_1]]</td><td>[[EQ:eq_7_t1]]</td></tr></table>"),
        ("figure", "fig_7_1", "figure on 7", None), ("text", "tb_7_2", "text | with [[EQ:eq_7_2]]", None)], key=repr)
