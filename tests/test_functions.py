"""Scalar functions on examples of their own."""

import pytest
from pyspark.sql import functions as F

from inkwright.functions import latex as L
from inkwright.functions import svg as S
from inkwright.functions import text as T


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert values(spark, fn, cases) == list(cases.values())


def test_simple_text(spark):
    check(spark, L.simple_text, {"x": "x", r"\alpha": "α", "x_{1}": "x<sub>1</sub>", r"\mathbf{v}": "<b>v</b>", r"\mathbb{R}": "ℝ", r"\mathbb{X}": None, "^{8}": "<sup>8</sup>", "^{a)}": "<sup>a)</sup>", "x = 3": "x=3", "42": None, "x_1^2": None, "x+y": None, r"x^\beta,": "x<sup>β</sup>,", r"\foo": None, "": None, r"t_{\mathrm{e}}": "t<sub>e</sub>"})


def test_tags(spark):
    check(spark, L.equation_number, {r"a=b \tag {5}": "(5)", r"\tag{5}\tag{(6)}": "(5), (6)", r"a \tag{}": None, "a": None})
    check(spark, L.without_tags, {r"a=b \tag {5}": "a=b", r"a \tag{}": "a"})


def test_normal_forms(spark):
    check(spark, L.normalize, {"  a  ^ b % c": "a^b", r"50\% a _ 1": r"50\% a_1", "a  b": "a b", r"\\ [ A": r"\\ {}[ A", r"\\[2pt] y": r"\\[2pt] y"})
    twice = values(spark, lambda x: L.normalize(L.normalize(x)) == L.normalize(x), ["a ^ { b }", r"x % y", r"\\ [ q ]", "  "])
    assert all(twice)
    keys = values(spark, L.cache_key, [r"50\% a", r"50\% b"])
    assert keys[0] != keys[1]


def test_labels(spark):
    check(spark, L.is_reference_label, {"(9)": True, "(9.1)": True, "34A.": True, "60See.": True, r"\psi_{2}": False, "B1": False, "1234": False})


def test_plausibility(spark):
    df = spark.createDataFrame([("",), ("q",), (r"\frac{a}{b}",), ("{{{",), (r"\foo \bar \baz",)], "x string")
    got = [tuple(r) for r in df.select(F.round(L.plausibility(F.col("x"), F.lit(True)), 2), F.round(L.plausibility(F.col("x"), F.lit(False)), 2)).collect()]
    assert got == [(0.0, 0.0), (1.0, 0.05), (1.0, 1.0), (0.7, 0.4), (0.79, 0.79)]


def test_links(spark):
    check(spark, lambda x: T.linkify(T.escape(x)), {"(see https://a.org/b_(c)).": '(see <a href="https://a.org/b_(c)">https://a.org/b_(c)</a>).', "<http://c.d/e> end": '&lt;<a href="http://c.d/e">http://c.d/e</a>&gt; end', "x@www.b.org": "x@www.b.org", "none": "none"})
    check(spark, T.trim_url, {"http://a/b].": "http://a/b", "http://a/(b)": "http://a/(b)", "...": ""})


def test_pipe_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td></td></tr></table>"
    check(spark, T.pipe_table_html, {"| a | b |\n|--|:-:|\n| 1 |": html, "| a |\n| b |\n| c |": None, "text": None})


def test_delimiters(spark):
    check(spark, T.delimiters, {"a $x$ b $$y$$ \\(z\\)": ["$x$", "$$y$$", "\\(z\\)"], "$5 and $10": ["$5 and $"], "none": []})


def test_svg(spark):
    check(spark, S.orphans, {'<path id="a"/><use href="#a"/>': [], "<g id='b'/><use xlink:href='#b'/>": ["b"]})
    check(spark, lambda x: S.namespace_ids(x, F.lit("p")), {'<path id="a"/><path id="ab"/><use href="#a"/><use href="#z"/>': '<path id="p__a"/><path id="p__ab"/><use href="#p__a"/><use href="#z"/>'})
    check(spark, S.current_color, {'<a fill="#000" stroke="red"/>': '<a fill="currentColor" stroke="red"/>'})


def test_scalar_plans_hold_no_python(spark):
    df = spark.createDataFrame([("x",)], "x string")
    for fn in (L.normalize, L.repair, L.simple_text, L.equation_number, L.strip_formatting, T.escape, T.linkify, S.clean, S.orphans, L.cache_key):
        plan = df.select(fn(F.col("x")))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("stderr", ["", "Undefined control sequence \\q", "Missing $ inserted", "odd"])
def test_compile_errors(spark, stderr):
    code = {"": "E501.compile", "odd": "E501.compile", "Missing $ inserted": "E501.brace"}.get(stderr, "E501.undef_cmd")
    assert values(spark, lambda x: L.compile_error(x)["sub_code"], [stderr]) == [code]
