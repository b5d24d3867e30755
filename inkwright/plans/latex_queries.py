"""Queries on formulas. The tables hold none, so they are made from a fixed list and the keys of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import svg as S
from ..functions import text as T
from ..operators import gate as G
from ..operators import markup as K
from ..operators import mathml as M

#: Formulas; a number takes the place of #.
FORMULAS = [
    r"x_{1}", r"\alpha", r"\mathbf{v}", r"\mathbb{R}", r"^{8}", r"x = #", "\\frac{#}{2} \\sum_{i} x^2 % note\n + y", r"a=b \tag {#}", r"\tag{1} x \tag{(2)} y", r"50\% of \psi_{#} ^ 2",
    r"\Sum_ij x^-ab + \vec {p}", r"\begin{array}{l} a \\ [ H_1 ] = #\end{array}", "α + β ≤ γ — ∑", r"\foo{\bar{x}}} $", r"(#)", r"34A.", r"\unknown \weird \int x", "x", r"\langle \psi | H | \psi \rangle = E_{#}", r"\\[2pt] y_#", "  ", r"\mathbb{X}",
]
ERRORS = ["", "! Undefined control sequence. l.3 \\foo", "! Missing $ inserted.", "! Extra }, or forgotten $.", "! LaTeX Error: #", "! Undefined control sequence"]
CELLS = ["A_\\alpha", "Affinity of cycle \\alpha.", "plain words only", "the ratio \\eta_{#} = 1 - x for each engine", "\\text{mean value} \\mu", "two plain words x^2"]
MATHML = [
    "<math><mfrac><mi>a</mi><mn>#</mn></mfrac></math>",
    "<math><semantics><mrow><mi>x</mi></mrow><annotation encoding='application/x-tex'>x_{#}</annotation></semantics></math>",
    "<math><munderover><mo>∑</mo><mi>i</mi><mn>#</mn></munderover><mfenced open='['><mi>a</mi><mi>b</mi></mfenced></math>",
    "<math><mi>broken",
]
PIPES = ["| a | b |\n|---|:--|\n| # | 2 |\n| 3 |", "| a | b |\n| # | 2 |", "no table #"]
LINKS = ["see https://a.org/x_(y). and more", "[DOI: doi: 10.1119/1.18116#].", "www.site.org/?a=1&b=2, then", "at 10.1000/xyz#", "mail a@www.b.org", "<http://c.d/e> end", "nothing", "(http://e.f/g[#])"]
_BOOK = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body>{}</body></html>'
#: Pages, and the rows that a walk makes of each: row, id, kind, class, text, note, label. @ is the order's key.
PAGES: list[tuple[str, list[tuple]]] = [
    (_BOOK.format("<h1>T #</h1><p>one <b>two</b></p><p> </p>"), [("text", "tb_@_1", "heading", None, "T #", None, None), ("text", "tb_@_2", "text", None, "one two", None, None)]),
    (_BOOK.format("<ul><li>a</li><li>b <i>#</i></li></ul><dl><dt>k</dt><dd>v</dd></dl>"), [("text", f"tb_@_{i}", "list_item", None, t, None, None) for i, t in enumerate(("a", "b #", "k", "v"), 1)]),
    (_BOOK.format("<script>x</script><pre>\n a = #\n</pre><p>end</p>"), [("text", "tb_@_1", "code", None, " a = #", None, None), ("text", "tb_@_2", "text", None, "end", None, None)]),
    (_BOOK.format("<table><tr><td>$x_#$</td></tr></table>"), [("equation", "eq_@_1", "delimiter", "inline", "x_#", None, None), ("figure", "fig_@_1", "figure", None, "table", None, None)]),
    (_BOOK.format('<img src="a.png" alt="plot #"/><img src="b.png" alt="x_#"/>'), [("figure", "fig_@_1", "figure", None, "plot #", None, None), ("equation", "eq_@_1", "image", "inline", "x_#", None, None), ("text", "tb_@_1", "text", None, "[[EQ:eq_@_1]]", None, None)]),
    (_BOOK.format('<math display="block"><mi>x</mi></math>'), [("equation", "eq_@_1", "mathml", "display", 'MATHML:<math display="block"><mi>x</mi></math>', None, None), ("text", "tb_@_1", "text", None, "[[EQ:eq_@_1]]", None, None)]),
    (_BOOK.format('<aside epub:type="footnote" id="fn#"><p>n #</p><p>more</p></aside>'), [("text", "tb_@_1", "footnote", None, "n #", "fn#", None), ("text", "tb_@_2", "footnote", None, "more", None, None)]),
    (_BOOK.format("<div><h2>Chart #</h2><canvas/></div>"), [("figure", "fig_@_1", "figure", None, "unsupported interactive content", None, 'Interactive content not shown — "Chart #"')]),
    (_BOOK.format("<div><canvas/></div><div>loose #<p> </p></div>"), [("figure", "fig_@_1", "figure", None, "unsupported interactive content", None, K.NO_LABEL), ("text", "tb_@_1", "text", None, "loose #", None, None)]),
    (_BOOK.format('<p>a<br/>b <img src="i.png" alt="pic"/>c <a epub:type="noteref" href="#_n1">1</a></p>'), [("equation", "eq_@_1", "noteref", "inline", "1", "#_n1", None), ("text", "tb_@_1", "text", None, "ab c [[EQ:eq_@_1]]", None, None)]),
    (_BOOK.format(r"<p>$a$ <math><mi>y</mi></math> \(b\)</p>"), [("equation", "eq_@_1", "mathml", "inline", "MATHML:<math><mi>y</mi></math>", None, None), ("equation", "eq_@_2", "delimiter", "inline", "a", None, None), ("equation", "eq_@_3", "delimiter", "inline", "b", None, None), ("text", "tb_@_1", "text", None, "[[EQ:eq_@_2]] [[EQ:eq_@_1]] [[EQ:eq_@_3]]", None, None)]),
    ("<p>open<p>next #", [("text", "tb_@_1", "text", None, "open", None, None), ("text", "tb_@_2", "text", None, "next #", None, None)]),
]
#: Here ~ is the number's place, as # is taken.
SVGS = [
    '<?xml version="1.0"?><svg width="24pt" height="6.5pt" xmlns:xlink="http://www.w3.org/1999/xlink"><path id="g1" fill="#000"/><use xlink:href="#g1"/><use xlink:href="#g~"/></svg>',
    '<svg width="~pt" height="1pt" viewBox="0 0 1 1"><path id="a"/><use href="#a"/><text font-size="12px" style="font-size:9px;">t</text></svg>',
    "<p>none</p>",
]


def _mark(forms: list[str]) -> str:
    return "~" if forms is SVGS else "#"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores: keys of millions of rows are a few MB, one task, and what is made of each is long."""
    return rows.repartition(max(64, 3 * rows.sparkSession.sparkContext.defaultParallelism), key)


def made(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    """id, n, x: the formula whose turn the order's key is, with the customer's key for #."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")
    form = F.get(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % len(forms)).cast("int"))
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n"), F.replace(form, F.lit(_mark(forms)), F.col("o_custkey").cast("string")).alias("x"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def made_sql(forms: list[str]) -> str:
    return f"(SELECT o_orderkey AS id, o_custkey AS n, replace([{', '.join(map(quoted, forms))}][(o_orderkey % {len(forms)})::INT + 1], '{_mark(forms)}', o_custkey::VARCHAR) AS x FROM orders)"


def each(forms: list[str], **columns) -> object:
    """A query of id and the columns, each a function of x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return made(spark, sf_dir, forms).select("id", *[f(F.col("x")).alias(c) for c, f in columns.items()])

    return run


def each_sql(forms: list[str], **columns: str) -> str:
    return f"SELECT id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {made_sql(forms)}"


def _nested(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


def _rx(x: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, {quoted(a)}, {quoted(b)}, 'g')"
    return x


UNITS = "pt|em|ex|mm|cm|in|bp|pc|dd|cc|sp|mu"
_breaks = lambda x: _nested(_rx(x, (rf"(\\\\\s*)\[(\s*-?[\d.]+\s*(?:{UNITS})\s*\])", "\\1\x01\\2"), (r"(\\\\\s*)\[", r"\1{}[")), [("\x01", "[")])
_squeeze = lambda x: _rx(x, (r"^\s+|\s+$", ""), (r"\s+", " "))
_tight = lambda x: _rx(_squeeze(x), (r"\s*\^\s*", "^"), (r"\s*_\s*", "_"))
NORMAL = lambda x: _tight(_breaks(_rx(x, (r"(^|[^\\])%[^\n]*", r"\1"))))
STRIPPED = lambda x: _rx(_rx(x, *[(rf"\\{k}([^A-Za-z]|$)", rf"{v}\1") for k, v in L.GREEK.items()]), (r"\\[a-zA-Z]+|\\[!,;:]", ""), (r"\\", ""), (r"[\^_]", ""), (r"[{}]", ""), (r"^\s+|\s+$", ""))


def _score_sql(x: str, trusted: str) -> str:
    s = f"trim({x}, ' ' || chr(10))"
    braces = f"abs((length({s}) - length(replace({s}, '{{', ''))) - (length({s}) - length(replace({s}, '}}', ''))))"
    known = "[" + ", ".join(map(quoted, L.KNOWN)) + "]"
    commands = f"regexp_extract_all({s}, '\\\\[a-zA-Z]+')"
    unknown = f"(len(list_filter({commands}, lambda c: NOT list_contains({known}, c)))::DOUBLE / greatest(len({commands}), 1))"
    signals = " + ".join(f"contains({s}, {quoted(c)})::INT" for c in L.SIGNALS)
    less = (
        f"(CASE WHEN length({s}) > 600 THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN length({s}) < 4 AND NOT ({trusted}) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {braces} > 2 THEN 0.3::DOUBLE WHEN {braces} > 0 THEN 0.1 ELSE 0 END"
        f" + CASE WHEN (length({s}) - length(replace({s}, '$', ''))) % 2 = 1 THEN 0.2::DOUBLE ELSE 0 END + 0.08::DOUBLE * least(length(regexp_replace({s}, '[\\x00-\\x7F]', '', 'g')), 4) + CASE WHEN {unknown} > 0.5 THEN 0.25::DOUBLE WHEN {unknown} > 0.25 THEN 0.1 ELSE 0 END)"
    )
    return f"CASE WHEN length({s}) = 0 THEN 0.0::DOUBLE WHEN length({s}) < 2 THEN CASE WHEN {trusted} THEN 1.0 ELSE 0.05 END ELSE greatest(0.0, least(1.0, 1.0 - {less} + 0.04::DOUBLE * ({signals}))) END"


def _round(c: Column) -> Column:
    return F.round(c, 6)


SIMPLE = {0: "x<sub>1</sub>", 1: "α", 2: "<b>v</b>", 3: "ℝ", 4: "<sup>8</sup>", 5: "x=#", 17: "x"}
_by_form = lambda known, forms: "CASE id % " + str(len(forms)) + " " + " ".join(f"WHEN {k} THEN replace({quoted(v)}, '#', n::VARCHAR)" for k, v in known.items()) + " END"
#: What the repair patterns make of each formula, worked out by hand; others stay as they are.
REPAIRED = {
    9: r"50\% of \psi_{#} ^{ 2}", 10: r"\Sum_{ij} x^{-ab} + \vec{p}", 11: r"\begin{array}{l} a \\ {}[ H_1 ] = #\end{array}", }


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, FORMULAS)
    score = L.plausibility(F.col("x"), F.col("n") % 2 == 0)
    return rows.withColumn("gate", G.gate(score, G.proxy_compiles(F.col("x")))).groupBy("gate").agg(F.count("*").alias("n"))


def _compiles_sql(x: str) -> str:
    known = "[" + ", ".join(map(quoted, L.KNOWN)) + "]"
    n = lambda ch: f"(length({x}) - length(replace({x}, '{ch}', '')))"
    return f"(len(list_filter(regexp_extract_all({x}, '\\\\[a-zA-Z]+'), lambda c: NOT list_contains({known}, c))) = 0 AND {n('{')} = {n('}')} AND {n('$')} % 2 = 0)"


def repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.validate(made(spark, sf_dir, FORMULAS), "x", F.col("n") % 2 == 0)
    return rows.select("id", "normalized", _round(F.col("score")).alias("score"), "gate", "repair_attempts", "error_code")


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw, fall = G.route(G.validate(made(spark, sf_dir, FORMULAS), "x", F.lit(True)))
    return draw.select("id", F.lit("draw").alias("route")).unionByName(fall.select("id", F.lit("fallback").alias("route")))


def cell_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, CELLS).select("id", F.posexplode(M.cell_segments(F.col("x"))).alias("pos", "s")).select("id", "pos", "s.kind", "s.chunk")


def table_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, CELLS).select("id", F.concat(F.lit("<table><tr><td>"), T.escape("x"), F.lit("</td></tr></table>")).alias("h"))
    got = rows.select("id", M.table_math(F.col("h"), F.format_string("t%d", "id")).alias("t"))
    return got.select("id", M.valid_table_html(F.col("t.html")).alias("html"), F.size("t.formulas").alias("formulas"))


def walked_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.walk_pages(made(spark, sf_dir, [p for p, _ in PAGES]).select(F.col("id").alias("page"), "x"), "page", "x")
    return rows.select(F.col("page").alias("order_id"), "row", F.col("id").alias("region"), "kind", "formula_class", "text", "note", "label")


def draw_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, SVGS).select("id", F.nullif(F.col("x"), F.lit("<p>none</p>")).alias("svg"), F.lit("pass").alias("gate"), F.lit(None).cast("string").alias("error_code"))
    out = G.draw_outcome(rows, "svg").withColumn("recognised_svg", F.when(F.col("id") % 2 == 0, "<svg/>"))
    return G.fallback_outcome(out.filter("gate = 'fallback'")).select("id", "draw_error", "gate", "fallback_used", "flagged", "error_code")


QUERIES = {
    "unicode_to_latex": each(FORMULAS, latex=L.unicode_to_latex),
    "row_break_fix": each(FORMULAS, latex=L.fix_row_breaks),
    "normalize_latex": each(FORMULAS, latex=L.normalize),
    "cache_key": each(FORMULAS, key=L.cache_key, display_key=lambda x: L.compile_key(x, F.lit("display"))),
    "repair_rewrite": each(FORMULAS, latex=L.repair),
    "simple_text": each(FORMULAS, html=L.simple_text),
    "strip_formatting": each(FORMULAS, core=L.strip_formatting),
    "reference_label": each(FORMULAS, label=L.is_reference_label),
    "equation_tag": each(FORMULAS, latex=L.without_tags, number=L.equation_number),
    "compiler_input": each(FORMULAS, tex=lambda x: L.compiler_input(x, F.when(F.col("n") % 2 == 0, "display").otherwise("inline"))),
    "plausibility": each(FORMULAS, trusted=lambda x: _round(L.plausibility(x, F.lit(True))), untrusted=lambda x: _round(L.plausibility(x, F.lit(False)))),
    "gate_counts": gate_counts,
    "repair_loop": repair_loop,
    "routing": routing,
    "compile_error_class": each(ERRORS, sub_code=lambda x: L.compile_error(x)["sub_code"], detail=lambda x: L.compile_error(x)["detail"]),
    "pure_math": each(CELLS, pure=L.is_pure_math),
    "cell_segments": cell_segments,
    "table_formulas": table_formulas,
    "mathml_to_latex": each(MATHML, latex=M.mathml_to_latex, tokens=M.math_tokens),
    "pipe_tables": each(PIPES, html=T.pipe_table_html, is_table=T.is_pipe_table),
    "linkify": each(LINKS, html=lambda x: T.linkify(T.escape(x))),
    "svg_orphans": each(SVGS, orphans=lambda x: F.array_join(S.orphans(x), ","), drawings=S.count),
    "svg_postprocess": each(SVGS, svg=lambda x: S.postprocess(x, F.format_string("eq_%d", "id"))),
    "svg_chain": each(SVGS, svg=lambda x: S.namespace_ids(S.clean(S.current_color(S.strip_font_size(x))), F.format_string("eq_%d", "id"))),
    "draw_checks": draw_checks,
    "walked_forms": walked_forms,
}

#: The two drawings after rewriting, worked out by hand: @ is the id, ~ the number, ^ its reference, % its width in em.
_CHAIN = (
    '<svg width="24pt" height="6.5pt"><path id="eq_@__g1" fill="currentColor"/><use href="#eq_@__g1"/><use href="#^"/></svg>',
    '<svg width="~pt" height="1pt" viewBox="0 0 1 1"><path id="eq_@__a"/><use href="#eq_@__a"/><text style="">t</text></svg>',
)
_POST = (
    '<svg width="2.0em" height="0.5417em" viewBox="0 0 24.0 6.5" style="vertical-align: middle;"><path id="eq_@__g1" fill="currentColor"/><use href="#eq_@__g1"/><use href="#^"/></svg>',
    '<svg viewBox="0 0 1 1" width="%em" height="0.0833em" style="vertical-align: middle;"><path id="eq_@__a"/><use href="#eq_@__a"/><text style="">t</text></svg>',
)


def _drawn(first: str, second: str) -> str:
    reference = "CASE WHEN n = 1 THEN 'eq_' || id || '__g1' ELSE 'g' || n END"
    put = lambda s: f"replace(replace(replace(replace({quoted(s)}, '@', id::VARCHAR), '~', n::VARCHAR), '^', {reference}), '%', round(n / 12, 4)::DOUBLE::VARCHAR)"
    return f"CASE id % 3 WHEN 0 THEN {put(first)} WHEN 1 THEN {put(second)} ELSE x END"


def _rows_by_form(forms: list[str], rows: list[tuple], names: str) -> str:
    """SQL of the rows (form, values...) that each order's form gives; # is the number, @ the key."""
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"replace(replace({quoted(v)}, '#', n::VARCHAR), '@', id::VARCHAR)"
    columns = names.split(", ")
    one = lambda r: "{" + ", ".join(f"{c}: {value(v)}" for c, v in zip(columns, r[1:])) + "}"
    lists = [", ".join(one(r) for r in rows if r[0] == k) for k in range(len(forms))]
    whens = " ".join(f"WHEN {k} THEN [{x}]" for k, x in enumerate(lists) if x)
    return f"SELECT id, unnest(CASE id % {len(forms)} {whens} END) AS r FROM {made_sql(forms)}"


#: The parts of each cell: form, place, kind, chunk.
_SEGMENTS = [
    (0, 0, "math", "A_\\alpha"), (1, 0, "text", "Affinity of cycle "), (1, 1, "math", "\\alpha"), (1, 2, "text", "."), (2, 0, "text", "plain words only"),
    (3, 0, "text", "the ratio "), (3, 1, "math", "\\eta_{#}"), (3, 2, "text", " = 1 - x for each engine"), (4, 0, "math", "\\text{mean value} \\mu"), (5, 0, "text", "two plain words "), (5, 1, "math", "x^2"),
]
#: Tables with their formulas as placeholders: form, html, number of formulas.
_TABLES = [(0, "[[EQ:t@_1]]", 1), (1, "Affinity of cycle [[EQ:t@_1]].", 1), (2, "plain words only", 0), (3, "the ratio [[EQ:t@_1]] = 1 - x for each engine", 1), (4, "[[EQ:t@_1]]", 1), (5, "two plain words [[EQ:t@_1]]", 1)]
#: What each element becomes, and its tokens.
_MATHS = {0: (r"\frac{a}{#}", "a #"), 1: ("x_{#}", "x"), 2: (r"\sum_{i}^{#} \left[ a , b \right)", "∑ i # a b"), 3: ("<math><mi>broken", None)}
_VALID = "(SELECT *, CASE WHEN normalized = '' THEN 'E402.empty' WHEN NOT fine THEN 'E501' WHEN gate <> 'pass' THEN 'E503.plausibility' END AS error_code FROM (SELECT *, CASE WHEN normalized = '' OR NOT fine THEN 'fallback' WHEN s >= 0.65 THEN 'pass' WHEN s >= 0.4 THEN 'repair' ELSE 'fallback' END AS gate FROM (SELECT *, {score} AS s, {fine} AS fine FROM (SELECT id, n, {normal} AS normalized FROM {made}))))"


def _valid(trusted: str) -> str:
    """Normal form, score and gate of each formula; no repair makes a gate of these better."""
    return _VALID.format(score=_score_sql("normalized", trusted), fine=_compiles_sql("normalized"), normal=NORMAL(_nested("x", L.UNICODE)), made=made_sql(FORMULAS))


_links_by_form = {
    0: 'see <a href="https://a.org/x_(y)">https://a.org/x_(y)</a>. and more', 1: '[DOI: <a href="https://doi.org/10.1119/1.18116#">doi: 10.1119/1.18116#</a>].', 2: '<a href="http://www.site.org/?a=1&amp;b=2">www.site.org/?a=1&amp;b=2</a>, then',
    3: 'at <a href="https://doi.org/10.1000/xyz#">10.1000/xyz#</a>', 4: "mail a@www.b.org", 5: '&lt;<a href="http://c.d/e">http://c.d/e</a>&gt; end', 6: "nothing", 7: "(http://e.f/g[#])",
}
ORACLES = {
    "unicode_to_latex": each_sql(FORMULAS, latex=_nested("x", L.UNICODE)),
    "row_break_fix": each_sql(FORMULAS, latex=_breaks("x")),
    "normalize_latex": each_sql(FORMULAS, latex=NORMAL("x")),
    "cache_key": each_sql(FORMULAS, key=f"sha256({NORMAL('x')})", display_key=f"sha256('display' || chr(0) || {NORMAL('x')})"),
    "repair_rewrite": f"SELECT id, CASE WHEN id % {len(FORMULAS)} = 19 AND n > 9 THEN '\\\\[2pt] y_{{' || n || '}}' ELSE coalesce({_by_form(REPAIRED, FORMULAS)}, x) END AS latex FROM {made_sql(FORMULAS)}",
    "simple_text": f"SELECT id, {_by_form(SIMPLE, FORMULAS)} AS html FROM {made_sql(FORMULAS)}",
    "strip_formatting": each_sql(FORMULAS, core=STRIPPED("x")),
    "reference_label": each_sql(FORMULAS, label=f"regexp_matches({STRIPPED('x')}, '^\\(\\s*\\d+(?:\\.\\d+)*\\s*\\)$') OR regexp_matches({STRIPPED('x')}, '^\\d{{1,3}}[A-Za-zΑ-ω]{{0,4}}[.,]?$')"),
    "equation_tag": each_sql(FORMULAS, latex=_rx("x", (r"\\tag\s*\{([^{}]*)\}", ""), (r"^\s+|\s+$", "")), number="nullif(array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(x, '\\\\tag\\s*\\{([^{}]*)\\}', 1), lambda t: trim(t)), lambda t: t <> ''), lambda t: CASE WHEN t[1] = '(' THEN t ELSE '(' || t || ')' END), ', '), '')"),
    "compiler_input": each_sql(FORMULAS, tex=f"{quoted(L.HEAD + L.PACKAGES + L.MIDDLE)} || CASE WHEN n % 2 = 0 THEN '\\[' || chr(10) || x || chr(10) || '\\]' ELSE '$' || x || '$' END || {quoted(L.TAIL)}"),
    "plausibility": each_sql(FORMULAS, trusted=f"round({_score_sql('x', 'true')}, 6)", untrusted=f"round({_score_sql('x', 'false')}, 6)"),
    "gate_counts": f"SELECT gate, count(*) AS n FROM (SELECT CASE WHEN NOT {_compiles_sql('x')} THEN 'fallback' WHEN s >= 0.65 THEN 'pass' WHEN s >= 0.4 THEN 'repair' ELSE 'fallback' END AS gate FROM (SELECT x, {_score_sql('x', 'n % 2 = 0')} AS s FROM {made_sql(FORMULAS)})) GROUP BY gate",
    "compile_error_class": f"SELECT id, CASE WHEN x = '' THEN 'E501.compile' WHEN contains(x, 'Undefined control sequence') THEN 'E501.undef_cmd' WHEN contains(lower(x), 'missing $') THEN 'E501.brace' WHEN contains(x, 'Extra }}') THEN 'E501.brace' ELSE 'E501.compile' END AS sub_code, CASE WHEN x = '' THEN 'Compilation failed (no stderr)' WHEN contains(x, 'Undefined control sequence') THEN 'Undefined command: ' || CASE WHEN contains(x, '\\foo') THEN '\\foo' ELSE 'unknown' END WHEN contains(lower(x), 'missing $') THEN 'Missing $ delimiter' WHEN contains(x, 'Extra }}') THEN 'Unmatched braces: ' || x[:80] ELSE x[:120] END AS detail FROM {made_sql(ERRORS)}",
    "pure_math": each_sql(CELLS, pure="len(regexp_extract_all(" + _rx("x", (r"\\(?:text|mathrm|mathbf|mbox|textrm)\s*\{[^{}]*\}", " "), (r"\\[a-zA-Z]+\*?", " ")) + ", '\\b[A-Za-z][A-Za-z''-]{2,}\\b')) < 2"),
    "pipe_tables": f"SELECT id, CASE WHEN id % 3 = 0 THEN '<table><tr><th>a</th><th>b</th></tr><tr><td>' || n || '</td><td>2</td></tr><tr><td>3</td><td></td></tr></table>' END AS html, id % 3 = 0 AS is_table FROM {made_sql(PIPES)}",
    "linkify": f"SELECT id, {_by_form(_links_by_form, LINKS)} AS html FROM {made_sql(LINKS)}",
    "svg_orphans": f"SELECT id, CASE WHEN id % 3 = 0 AND n <> 1 THEN 'g' || n ELSE '' END AS orphans, CASE WHEN id % 3 < 2 THEN 1 ELSE 0 END::INT AS drawings FROM {made_sql(SVGS)}",
    "svg_chain": f"SELECT id, {_drawn(*_CHAIN)} AS svg FROM {made_sql(SVGS)}",
    "svg_postprocess": f"SELECT id, {_drawn(*_POST)} AS svg FROM {made_sql(SVGS)}",
    "repair_loop": f"SELECT id, normalized, round(s, 6) AS score, gate, 0::INT AS repair_attempts, error_code FROM {_valid('n % 2 = 0')}",
    "routing": f"SELECT id, CASE WHEN gate IN ('pass', 'repair') THEN 'draw' ELSE 'fallback' END AS route FROM {_valid('true')}",
    "draw_checks": f"SELECT id, CASE WHEN id % 3 = 2 THEN 'E601' ELSE 'E602' END AS draw_error, CASE WHEN id % 2 = 0 THEN 'fallback' ELSE 'flagged' END AS gate, id % 2 = 0 AS fallback_used, id % 2 = 1 AS flagged, CASE WHEN id % 2 = 1 THEN 'E603' END AS error_code FROM {made_sql(SVGS)} WHERE id % 3 = 2 OR id % 3 = 0 AND n <> 1",
    "cell_segments": f"SELECT id, r.pos::INT AS pos, r.kind AS kind, r.chunk AS chunk FROM ({_rows_by_form(CELLS, _SEGMENTS, 'pos, kind, chunk')})",
    "table_formulas": f"SELECT id, '<table><tr><td>' || r.html || '</td></tr></table>' AS html, r.formulas::INT AS formulas FROM ({_rows_by_form(CELLS, _TABLES, 'html, formulas')})",
    "mathml_to_latex": f"SELECT id, r.latex AS latex, r.tokens AS tokens FROM ({_rows_by_form(MATHML, [(k, *v) for k, v in _MATHS.items()], 'latex, tokens')})",
    "walked_forms": f"SELECT id AS order_id, r.row AS row, r.region AS region, r.kind AS kind, r.formula_class AS formula_class, r.text AS text, r.note AS note, r.label AS label FROM ({_rows_by_form([p for p, _ in PAGES], [(k, *r) for k, (_, rows) in enumerate(PAGES) for r in rows], 'row, region, kind, formula_class, text, note, label')})",
}
