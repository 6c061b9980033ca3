"""Links between pages: how they are resolved, what they pass on, and that addresses inside a query are no links."""

import random
from urllib.parse import urljoin, urlsplit

import duckdb

from trailgrid.llm import oracles, urls

from .test_sql import same


def pages(spark, rows):
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    return spark.createDataFrame(rows, "page_id long, url string, html string"), con


def canonical(to):
    return f"<head><link rel='canonical' href='{to}'></head>"


def test_relative_links_reach_aliases_and_queries_invent_none(spark):
    rows = [
        (1, "http://a.com/de/x", canonical("/plain")), (2, "http://a.com/plain", None), (3, "http://b.com/de/1", canonical("//c.net/y")), (4, "https://c.net/y/", ""),
        (5, "http://d.com/de/k/z", canonical("../w?q=1")), (6, "http://d.com/de/w?q=1", None), (7, "http://e.com/de/2", canonical("/login?next=http://victim.net/")), (8, "http://victim.net/", ""),
        (9, "http://f.com/de/2", canonical("mailto:x@y.net") + "<meta http-equiv=refresh content='1;url=one.html'>"), (10, "http://f.com/de/one.html", ""), (11, "http://y.net/", ""), (12, "http://g.net", canonical("/de/x")), (13, None, canonical("/a")),
    ]
    df, con = pages(spark, rows)
    judged = urls.judge(df)
    verdict = {r.page_id: r.verdict for r in judged.collect()}
    assert verdict[2] == verdict[4] == "block" and verdict[8] == verdict[11] == verdict[12] == verdict[13] == "allow"
    same(judged, con.sql(oracles.URLS))


def test_links_as_the_standard_library_joins_them(spark):
    rng = random.Random(4)
    bases, links = ["http://h.com/a/b/c", "http://h.com", "https://k.org/x/?q=1", "http://h.com/a/b/"], ["d", "../d", "../../e/./f", "/g//h", "?z=2", "//m.net/p", "http://n.net/q#r", "./", "../../../up", "i/../j", "k?u=http://o.net/"]
    rows = [(i, rng.choice(bases), canonical(rng.choice(links))) for i in range(200)]
    key = lambda u: (lambda s: (s.netloc, [x for x in s.path.split("/") if x], s.query))(urlsplit(u))
    made = spark.createDataFrame([(b, x, urljoin(b, x)) for b in bases for x in links], "url string, link string, whole string")
    got = made.select("url", "link", "whole", (urls.target_key("url", made.link) == urls.alias_key("whole")).alias("same")).collect()
    assert [(r.url, r.link, key(r.whole)) for r in got if not r.same] == []
    df, con = pages(spark, rows)
    same(urls.judge(df), con.sql(oracles.URLS))


def test_given_redirects(spark):
    df, _ = pages(spark, [(1, "http://a.com/de/", ""), (2, "http://b.net/", ""), (3, "http://c.org/", "")])
    hops = spark.createDataFrame([("http://b.net/", "http://hop.net/"), ("http://hop.net/", "http://a.com/de/"), ("http://c.org/", "http://d.net/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urls.judge(df, redirects=hops).collect()} == {1: "block", 2: "block", 3: "allow"}
