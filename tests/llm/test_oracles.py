"""The operators that SQL can express against DuckDB, on the whole smallest tables."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
