"""Every query with SQL gives what DuckDB gives for that SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from summitry.plans import queries as core
from tests.conftest import SMALL


def key(row):
    out = []
    for x in row:
        if isinstance(x, float) or type(x).__name__ == "Decimal":
            out.append("nan" if math.isnan(x) else repr(round(float(x), 6) + 0.0))
        else:
            out.append(str(x))
    return tuple(out)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = core.Q[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(core.SQL[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(key(r) for r in df.select(*columns).collect()) == sorted(key([r[i] for i in order]) for r in want)


@pytest.mark.parametrize("name", sorted(set(core.Q) - set(core.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert core.Q[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).agg({"n": "sum"}).first()[0] == 500
    assert set(core.Q) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
