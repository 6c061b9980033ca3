"""The queries that have SQL against DuckDB, on the small tables and on pages with links."""

import os

import duckdb
import pytest

from trailgrid.llm import oracles, urls
from trailgrid.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert [x for x in zip(got, want) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    same(QUERIES[name](spark, DATA), con.sql(ORACLES[name]))


def test_urls_with_links(spark):
    link = lambda to: f"<head><link href='{to}' rel=canonical><meta http-equiv='refresh' content='0; url=http://r.net/1'></head>"
    rows = [(1, "http://a.com/de/x", link("http://b.net/y/")), (2, "http://B.net/y#z", None), (3, "http://r.net/1?q", ""), (4, "http://r.net/1/", ""), (5, None, link("x")), (6, "https://c.org/", link("http://d.net/")), (7, "http://d.net", "<link rel=next href='http://a.com/de/x'>"), (8, "nothing", ""), (9, "http://example.org/en/12", link("/rel")), (10, "http://example.org/es", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    same(urls.judge(pages), con.sql(oracles.URLS))
