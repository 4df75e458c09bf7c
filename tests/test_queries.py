"""Every registered query against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from watchtide.plans import catalogue

DIR = "/root/testdata/sf0.01"
SQL = catalogue.oracle_sql()


def rows(names, values):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    made = catalogue.queries()[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    got = rows(made.columns, [tuple(r) for r in made.collect()])
    assert got
    assert got == rows(want.columns, want.fetchall())
