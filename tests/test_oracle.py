"""Each query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trailgrid.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    norm = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(rel.fetchall(), list(rel.columns))
    assert len(got) == len(want)
    assert [g for g, w in zip(got, want) if g != w][:3] == [w for g, w in zip(got, want) if g != w][:3]
