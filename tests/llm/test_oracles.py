"""Registered queries that SQL can state, against their SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

from watchtide.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    made, want = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in made.collect())))
    at = [want.columns.index(c) for c in columns]
    assert got and got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
