"""Small string helpers with Unicode-aware white space."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def strip(x: Column) -> Column:
    """Without white space at either end, line ends and no-break spaces included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def replace_all(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, x)


def rewrite_all(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern replacements, one after the other."""
    return reduce(lambda a, r: F.regexp_replace(a, r[0], r[1]), rules, x)


def count_of(x: Column, literal: str) -> Column:
    """Occurrences of a one-character string."""
    return F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
