"""Table functions: formulas in table cells as rows, for DataFrames and SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NAME = "table_formulas"
#: What a table without formulas never holds: a backslash, a script or a dollar sign.
MAY_HOLD = r"[\\^_$]"
ADDED = (("row_kind", StringType()), ("html", StringType()), ("formula", IntegerType()), ("cell_row", IntegerType()), ("cell_col", IntegerType()), ("region_id", StringType()), ("latex", StringType()))
_TAG = re.compile(r"<(tr|td|th)\b", re.I)


def places(html: str) -> dict[int, tuple[int, int]]:
    """Row and column, from 1, of the cell that opens at each offset."""
    out, row, col = {}, 0, 0
    for m in _TAG.finditer(html):
        if m[1].lower() == "tr":
            row, col = row + 1, 0
        else:
            col += 1
            out[m.start()] = (max(row, 1), col)
    return out


class TableFormulas:
    """``table_formulas(TABLE(t) PARTITION BY ... ORDER BY ..., html => 'column', prefix => 'column')``

    For each row of t: one row ``table`` with the markup, its formulas as placeholders, then one row
    ``formula`` for each formula, with its cell. Formulas are numbered from 1 through a partition, in
    its order, and named ``<prefix>_t<number>``. All columns of t but the markup are kept. A null
    table gives a row with null; a null prefix counts as empty.
    """

    @staticmethod
    def analyze(t: AnalyzeArgument, html: AnalyzeArgument, prefix: AnalyzeArgument) -> AnalyzeResult:
        if not t.isTable or not isinstance(t.dataType, StructType):
            raise ValueError(f"{NAME}: the first argument must be a table")
        names = t.dataType.fieldNames()
        for a in (html, prefix):
            if not a.isConstantExpression or a.value not in names:
                raise ValueError(f"{NAME}: html and prefix must name columns of the table, which are {names}")
        clash = {n.lower() for n, _ in ADDED} & {n.lower() for n in names if n != html.value}
        if clash:
            raise ValueError(f"{NAME}: the table has columns named as results are: {sorted(clash)}")
        schema = StructType()
        for f in t.dataType.fields:
            if f.name != html.value:
                schema = schema.add(f.name, f.dataType)
        for name, kind in ADDED:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.n = 0

    def eval(self, t, html: str, prefix: str):
        from ..operators.mathml import cell_formulas

        row = t.asDict()
        markup, stem = row.pop(html), row.get(prefix)
        kept = tuple(row.values())
        if markup is None:
            yield (*kept, "table", None, None, None, None, None, None)
            return
        stem, first = "" if stem is None else f"{stem}_", self.n
        shown, found = cell_formulas(markup, lambda k: f"{stem}t{first + k}")
        at = places(markup)
        yield (*kept, "table", shown, None, None, None, None, None)
        for start, latex in found:
            self.n += 1
            yield (*kept, "formula", None, self.n, *at[start], f"{stem}t{self.n}", latex)


def register(spark: SparkSession) -> None:
    """Make table_formulas known to SQL."""
    spark.udtf.register(NAME, F.udtf(TableFormulas))


def formulas_in_tables(tables: DataFrame, html: str, prefix: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows of table_formulas for every table. Python sees no table that can't hold a formula.

    Tables without a backslash, script or dollar sign, and null ones, are passed on by the JVM; they
    have no formulas, so numbers stay as they are. A partition's other tables meet in one task.
    """
    register(tables.sparkSession)
    may = F.coalesce(F.col(html).rlike(MAY_HOLD), F.lit(False))
    plain = tables.filter(~may)
    kept = [c for c in tables.columns if c != html]
    blank = {name: F.lit(None).cast(kind) for name, kind in ADDED} | {"row_kind": F.lit("table"), "html": F.col(html)}
    plain = plain.select(*kept, *[c.alias(n) for n, c in blank.items()])
    some = tables.filter(may).asTable().partitionBy(*partition).orderBy(*order)
    return F.udtf(TableFormulas)(some, F.lit(html), F.lit(prefix)).unionByName(plain)
