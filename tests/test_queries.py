"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from inkwright.plans import book_queries, formula_queries, latex_queries, row_queries, run_queries, table_queries

SF = "/root/testdata/sf0.001"
ORACLES = table_queries.ORACLES | latex_queries.ORACLES | row_queries.ORACLES | run_queries.ORACLES | book_queries.ORACLES | formula_queries.ORACLES
QUERIES = table_queries.QUERIES | latex_queries.QUERIES | row_queries.QUERIES | run_queries.QUERIES | book_queries.QUERIES | formula_queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(cols), sorted((tuple(flat(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
