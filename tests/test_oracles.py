"""Every query with a SQL twin gives the twin's rows, over whole tables."""

import glob
import os

import duckdb
import pytest

from weftlens.plans import conversion, problems, reference

QUERIES, ORACLES = problems.QUERIES | reference.QUERIES | conversion.QUERIES, problems.ORACLES | reference.ORACLES | conversion.ORACLES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    twin = duck.sql(ORACLES[name])
    assert sorted(twin.columns) == columns
    place = [twin.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in place) for r in twin.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
