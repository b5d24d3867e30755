"""Structure of formulas, checked by a pushdown automaton that folds over their tokens on the JVM.

What a compiler would stop at in math mode: groups, environments and \\left ... \\right that don't nest,
second scripts, scripts and commands without their arguments, alignment marks outside an environment,
dollar and hash signs. It knows no packages: commands count as known by a list, and text arguments
are read as formulas are. Nothing is drawn, so it stands in for a compiler only as far as it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import latex as L
from .strings import let

TOKEN = r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}|\\sqrt\s*\[[^\]]*\]|\\[A-Za-z]+|\\[^A-Za-z]|\\|[{}^_&$#]|[^\s\\]"
#: Arguments that a command takes; others take none.
ARGUMENTS = {r"\frac": 2, r"\dfrac": 2, r"\tfrac": 2, r"\binom": 2, r"\overset": 2, r"\underset": 2, r"\stackrel": 2} | dict.fromkeys(
    (r"\sqrt", r"\vec", r"\hat", r"\bar", r"\dot", r"\ddot", r"\tilde", r"\overline", r"\underline", r"\overbrace", r"\underbrace", r"\mathbb", r"\mathcal", r"\mathbf", r"\mathrm", r"\mathit", r"\boldsymbol", r"\operatorname", r"\text", r"\bra", r"\ket", r"\braket", r"\tag", r"\label"), 1)
#: Tokens that are no atom: they leave scripts as they are.
PASSED = ("'", r"\limits", r"\nolimits", r"\displaystyle", r"\textstyle", r"\quad", r"\qquad", r"\,", r"\;", r"\:", r"\!", r"\ ")
STRUCTURAL = (r"\dfrac", r"\tfrac", r"\binom", *(c for c in PASSED if c[1:].isalpha()))
#: Sub-codes of the classes; all others are E501.compile.
SUB_CODES = {"extra_close": "E501.brace", "unclosed_group": "E501.brace", "math_shift": "E501.brace", "unknown_command": "E501.undef_cmd"}

_LEVEL = "struct<kind:string,pending:string,flags:string,need:int>"
_STATE = ("stack", "pending", "flags", "need", "delim", "err")


def _state(s: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, s[k]).alias(k) for k in _STATE])


def _lit(x) -> Column:
    return F.lit(x)


def _top(s: Column) -> Column:
    return F.coalesce(F.try_element_at(s["stack"], _lit(-1))["kind"], _lit(""))


def _err(s: Column, code: str | Column) -> Column:
    return _state(s, err=_lit(code) if isinstance(code, str) else code)


def _push(s: Column, kind: Column, **more: Column) -> Column:
    level = F.struct(kind.alias("kind"), s["pending"].alias("pending"), s["flags"].alias("flags"), s["need"].alias("need"))
    return _state(s, stack=F.concat(s["stack"], F.array(level)), pending=_lit(""), flags=_lit(""), need=_lit(0), **more)


def _atom(s: Column, **more: Column) -> Column:
    """An atom ends: it is an argument still due, or a script, or what scripts stand on next."""
    need = F.greatest(s["need"] - 1, _lit(0))
    done = need == 0
    return _state(s, need=need, pending=F.when(done, "").otherwise(s["pending"]), flags=F.when(done & (s["pending"] == ""), "").otherwise(s["flags"]), **more)


def _pop(s: Column, **more: Column) -> Column:
    """The level closes and is an atom of the one around it."""
    top = F.try_element_at(s["stack"], _lit(-1))
    outer = _state(s, stack=F.slice(s["stack"], _lit(1), F.size(s["stack"]) - 1), pending=top["pending"], flags=top["flags"], need=top["need"])
    return let(outer, lambda o: _atom(o, **more))


def _due(s: Column) -> Column:
    return (s["pending"] != "") | (s["need"] > 0)


def _step(s: Column, t: Column) -> Column:
    script = t.isin("^", "_")
    name = F.regexp_extract(t, r"\{(.*)\}", 1)
    begins, ends = t.startswith(r"\begin") & (name != ""), t.startswith(r"\end") & (name != "")
    closes = t.isin("}", "&", r"\right", r"\\") | ends
    command = F.when(t.startswith(r"\sqrt"), _lit(r"\sqrt")).otherwise(t)
    takes = F.coalesce(F.try_element_at(F.create_map(*[_lit(v) for kv in ARGUMENTS.items() for v in kv]), command), _lit(0))
    wrong = F.when(_top(s) == "L", "unclosed_left").when(_top(s).startswith("E"), "unclosed_environment").when(_top(s) == "{", "unclosed_group")
    return (
        F.when(s["err"].isNotNull(), s)
        .when(s["delim"], F.when(t.isin("{", "}"), _err(s, "missing_delimiter")).otherwise(_state(s, delim=_lit(False))))
        .when((closes | script) & _due(s), _err(s, "missing_argument"))
        .when(t == "{", _push(s, _lit("{")))
        .when(t == "}", F.when(_top(s) == "{", _pop(s)).otherwise(_err(s, F.when(_top(s) == "", "extra_close").otherwise(wrong))))
        .when(t == r"\left", _push(s, _lit("L"), delim=_lit(True)))
        .when(t == r"\right", F.when(_top(s) == "L", _pop(s, delim=_lit(True))).otherwise(_err(s, "extra_right")))
        .when(begins, _push(s, F.concat(_lit("E"), name)))
        .when(ends, F.when(_top(s) == F.concat(_lit("E"), name), _pop(s)).otherwise(_err(s, "mismatched_end")))
        .when(script, F.when(F.contains(s["flags"], t), _err(s, F.when(t == "^", "double_superscript").otherwise("double_subscript"))).otherwise(_state(s, pending=t, flags=F.concat(s["flags"], t))))
        .when(t == "&", F.when(_top(s).startswith("E"), _state(s, flags=_lit(""))).otherwise(_err(s, "misplaced_alignment")))
        .when(t == r"\\", _state(s, flags=_lit("")))
        .when(t == "$", _err(s, "math_shift"))
        .when(t == "#", _err(s, "parameter_char"))
        .when(t == "\\", _err(s, "lone_backslash"))
        .when(t.isin(*PASSED), s)
        .when(takes > 0, _state(s, need=F.greatest(s["need"] - 1, _lit(0)) + takes))
        .otherwise(_atom(s))
    )


def structure_error(x: Column) -> Column:
    """The first fault of a formula's structure, by class; null for none, and for null.

    extra_close, unclosed_group, unclosed_environment, mismatched_end, unclosed_left, extra_right,
    missing_delimiter, double_superscript, double_subscript, missing_argument, misplaced_alignment,
    math_shift, parameter_char, lone_backslash. A command with arguments that is itself an argument
    takes its own along.
    """
    tokens = F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    first = F.struct(F.array().cast(f"array<{_LEVEL}>").alias("stack"), _lit("").alias("pending"), _lit("").alias("flags"), _lit(0).alias("need"), _lit(False).alias("delim"), F.lit(None).cast("string").alias("err"))

    def end(s: Column) -> Column:
        top = _top(s)
        return F.when(s["err"].isNotNull(), s["err"]).when(s["delim"], "missing_delimiter").when(_due(s), "missing_argument").when(top == "{", "unclosed_group").when(top == "L", "unclosed_left").when(top != "", "unclosed_environment")

    return F.aggregate(tokens, first, _step, end)


def unknown_command(x: Column) -> Column:
    """The first command that isn't known; null for none. Environments' names are not looked at."""
    known = F.array(*[_lit(c) for c in dict.fromkeys((*L.KNOWN, *STRUCTURAL))])
    return F.get(F.filter(F.regexp_extract_all(x, F.lit(r"\\[A-Za-z]+"), F.lit(0)), lambda c: ~F.array_contains(known, c)), F.lit(0))


def compiles(x: Column) -> Column:
    """Whether a formula has no fault of structure and no unknown command: a check for ``gate.validate``."""
    return structure_error(x).isNull() & unknown_command(x).isNull()


def check(x: Column) -> Column:
    """sub_code and detail as a compiler's message gives them (see latex.compile_error); null if all is well."""
    codes = F.create_map(*[_lit(v) for kv in SUB_CODES.items() for v in kv])

    def told(s: Column) -> Column:
        undefined = F.struct(_lit(SUB_CODES["unknown_command"]).alias("sub_code"), F.concat(_lit("Undefined command: "), unknown_command(x)).alias("detail"))
        structural = F.struct(F.coalesce(F.try_element_at(codes, s), _lit("E501.compile")).alias("sub_code"), s.alias("detail"))
        return F.when(s.isNotNull(), structural).when(unknown_command(x).isNotNull(), undefined)

    return let(structure_error(x), told)
