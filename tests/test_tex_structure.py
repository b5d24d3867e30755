"""The structure of formulas, token by token."""

import re

from pyspark.sql import functions as F

from inkwright.functions import tex_structure as S
from inkwright.operators import gate

FORMS = {
    r"\frac{a}{b} + x^{2}_{i}": None, r"x^a_b": None, r"x^{a^{b}}": None, r"x'^2": None, r"\sum\limits_{i}^{n} i": None, r"\sqrt[3]{x}^2": None, r"\frac12^3": None, r"x^\frac{1}{2}": None,
    r"\begin{array}{l} a & b \\ c \end{array}^2": None, r"\left( \frac{a}{b} \right)^2": None, r"\left\{ x \right.": None, r"\begin{matrix} \left[ a \right] & b_1^2 \end{matrix}": None, r"50\% \$": None, "": None,
    r"a}": "extra_close", r"{a": "unclosed_group", r"{a \right)": "extra_right", r"\left( {a \right) }": "extra_right", r"\left( a": "unclosed_left", r"\left( a }": "unclosed_left", r"a \left": "missing_delimiter", r"\left{ a \right}": "missing_delimiter",
    r"\begin{array} a": "unclosed_environment", r"\begin{array} a \end{matrix}": "mismatched_end", r"a \end{array}": "mismatched_end", r"\begin{array} a }": "unclosed_environment", r"{ \begin{array} a \end{array}": "unclosed_group",
    r"x^a^b": "double_superscript", r"x_a_b": "double_subscript", r"x^{a}_b^{c}": "double_superscript", r"x^": "missing_argument", r"{x^}": "missing_argument", r"x^^2": "missing_argument", r"\frac{a}": "missing_argument", r"\frac{a} & b": "missing_argument", r"\vec": "missing_argument", r"\frac^2": "missing_argument",
    r"a & b": "misplaced_alignment", r"\begin{array} {a & b} \end{array}": "misplaced_alignment", r"a $ b": "math_shift", r"a # b": "parameter_char", "a \\": "lone_backslash", r"a } x^a^b": "extra_close",
}


def test_classes(spark):
    df = spark.createDataFrame([(x, e) for x, e in FORMS.items()], "x string, want string")
    got = df.withColumn("got", S.structure_error(F.col("x"))).collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]
    assert spark.range(1).select(S.structure_error(F.lit(None).cast("string")).alias("e")).first().e is None


def plain(x):
    """The same grammar by recursive descent."""
    tokens = re.findall(S.TOKEN, x)
    at = 0

    class Fault(Exception):
        pass

    def level(kind):
        nonlocal at
        flags, pending, need = "", "", 0

        def atom():
            nonlocal flags, pending, need
            need = max(need - 1, 0)
            if not need:
                if not pending:
                    flags = ""
                pending = ""

        while at < len(tokens):
            t = tokens[at]
            ends = re.match(r"\\end\s*\{(.*)\}", t)
            if (t in ("}", "&", "\\right", "\\\\", "^", "_") or ends) and (pending or need):
                raise Fault("missing_argument")
            at += 1
            begins = re.match(r"\\begin\s*\{(.*)\}", t)
            if t == "{":
                level("{")
                atom()
            elif t == "}":
                if kind == "{":
                    return
                raise Fault("extra_close" if kind == "" else "unclosed_left" if kind == "L" else "unclosed_environment")
            elif t in ("\\left", "\\right"):
                if t == "\\right" and kind != "L":
                    raise Fault("extra_right")
                if at >= len(tokens) or tokens[at] in "{}":
                    raise Fault("missing_delimiter")
                at += 1
                if t == "\\right":
                    return
                level("L")
                atom()
            elif begins:
                level("E" + begins[1])
                atom()
            elif ends:
                if kind != "E" + ends[1]:
                    raise Fault("mismatched_end")
                return
            elif t in "^_":
                if t in flags:
                    raise Fault("double_superscript" if t == "^" else "double_subscript")
                flags, pending = flags + t, t
            elif t == "&":
                if not kind.startswith("E"):
                    raise Fault("misplaced_alignment")
                flags = ""
            elif t == "\\\\":
                flags = ""
            elif t in ("$", "#", "\\"):
                raise Fault({"$": "math_shift", "#": "parameter_char", "\\": "lone_backslash"}[t])
            elif t in S.PASSED:
                pass
            elif n := S.ARGUMENTS.get("\\sqrt" if t.startswith("\\sqrt") else t):
                need = max(need - 1, 0) + n
            else:
                atom()
        if pending or need:
            raise Fault("missing_argument")
        if kind:
            raise Fault({"{": "unclosed_group", "L": "unclosed_left"}.get(kind, "unclosed_environment"))

    try:
        level("")
    except Fault as e:
        return str(e)
    return None


def test_plain_version_agrees_on_the_forms():
    assert {x: plain(x) for x in FORMS} == FORMS


PIECES = ["{", "}", "{", "}", "^", "_", "a", "b", "&", r"\left", r"\right", "(", ")", r"\frac", r"\sqrt", r"\sqrt[3]", r"\begin{array}", r"\end{array}", r"\begin{matrix}", r"\end{matrix}", r"\\", r"\alpha", "'", r"\,", "$", "#", "\\ ", " "]


def test_random_tokens(spark):
    import random

    r = random.Random(3)
    made = [" ".join(r.choice(PIECES[: r.choice([8, 14, 28])]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in made], "x string").withColumn("e", S.structure_error(F.col("x"))).collect()
    assert [(r.x, r.e) for r in got] == [(r.x, plain(r.x)) for r in got] and len({r.e for r in got}) > 12


def test_check_and_accepted_repairs(spark):
    df = spark.createDataFrame([(1, r"\In f d x"), (2, r"\Nu + x^{2}"), (3, r"\frac{a}{b}"), (4, r"\wrong x"), (5, r"{x"), (6, "")], "id int, x string")
    told = {r.id: r.c and tuple(r.c) for r in df.select("id", S.check(F.col("x")).alias("c")).collect()}
    assert told == {1: ("E501.undef_cmd", r"Undefined command: \In"), 2: ("E501.undef_cmd", r"Undefined command: \Nu"), 3: None, 4: ("E501.undef_cmd", r"Undefined command: \wrong"), 5: ("E501.brace", "unclosed_group"), 6: None}
    got = {r.id: (r.normalized, r.gate, r.repair_attempts, r.error_code) for r in gate.validate(df, "x", F.lit(True), S.compiles).collect()}
    assert got == {1: (r"\int f d x", "pass", 1, None), 2: (r"\nu + x^{2}", "pass", 1, None), 3: (r"\frac{a}{b}", "pass", 0, None), 4: (r"\wrong x", "fallback", 0, "E501"), 5: ("{x", "fallback", 0, "E501"), 6: ("", "fallback", 0, "E402.empty")}
