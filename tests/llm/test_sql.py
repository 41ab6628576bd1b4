"""The queries with SQL give what DuckDB gives for that SQL."""

import os

import duckdb
import pytest

from summitry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    result = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(result.fetchall())
