"""URL rules and redirect equivalence."""

import pytest
from pyspark.sql import functions as F

from meterlens.llm.redirect import alias_edges, decide, host_of, judge_urls, path_of, resolved

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("both.net", "/", "block"), ("both.net", "/", "allow")]


def plain(host, path):
    best = None
    for h, p, v in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), v == "allow")
            best = max(best or (key, h + p, v), (key, h + p, v))
    return best


def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


CASES = [("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x"), ("https://example.org", "example.org", ""), ("x://h?q/p", "h", ""),
         ("http://h#f/p", "h", ""), ("no scheme", "", ""), (None, "", ""), ("", "", ""), ("a://b://c/d", "b:", "//c/d"), ("http:///p", "", "/p"),
         ("http://ÄB.com/De/", "Äb.com", "/De/"), ("https://x.com/de/" + "y" * 50_000, "x.com", "/de/" + "y" * 50_000)]


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in CASES], "url string")
    got = df.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [(h, p) for _, h, p in CASES]


def test_longest_rule_wins(spark):
    urls = [(h, p) for h in ("org", "a.example.org", "example.org", "notexample.org", "x.com", "com", "both.net", "a.b", "")
            for p in ("", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/a", "/de/a")]
    got = {(r.host, r.path): (r.rule, r.rule_verdict) for r in decide(spark.createDataFrame(urls, "host string, path string"), rules(spark)).collect()}
    want = {u: plain(*u)[1:] for u in urls if plain(*u)}
    assert got == want


PAGES = [(1, "http://a.com/de/1", None), (2, "http://b.net/x", '<html><link rel="canonical" href="http://a.com/de/1"></html>'),
         (3, "https://c.net/y?z=1#top", "<head><META HTTP-EQUIV='refresh' content='0; url=http://b.net/x'>"),
         (4, "http://d.org/p", "<link href='https://c.net/y?z=1' rel=canonical>"), (5, "http://e.net/q", "<link rel='stylesheet' href='http://a.com/de/1'>"),
         (6, "http://f.net/a/b", '<link rel="canonical" href="../../x">'), (7, None, "<link rel=canonical href='http://a.com/de/1'>"), (8, "nothing", ""),
         (9, "http://b.net/x", None), (10, "http://g.net/a", '<link rel="canonical" href="/b">'), (11, "http://g.net/b", "")]


def test_blocks_reach_aliases_but_not_allowed_pages(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string")
    judged = judge_urls(pages, alias_edges(pages), rules(spark))
    got = {r.page_id: (r.rule, r.verdict) for r in judged.select("row.page_id", "rule", "verdict").collect()}
    assert len(got) == len(PAGES) and judged.select("row.*").columns == pages.columns
    assert got[1] == ("com/de/", "block") and got[2] == (None, "block") and got[3] == (None, "block") and got[9] == (None, "block")
    assert got[4] == ("org/", "allow")  # its own allow rule protects it
    assert got[5] == got[6] == got[7] == got[8] == got[10] == got[11] == (None, "allow")
    parts = {r.page_id: r.component for r in judged.select("row.page_id", "component").collect()}
    assert parts[1] == parts[2] == parts[3] == parts[4] and parts[10] == parts[11] != parts[1] and parts[5] is None


def test_edges(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in alias_edges(pages).collect()}
    assert ("http://g.net/a", "http://g.net/b") in got and ("http://b.net/x", "http://a.com/de/1") in got and len(got) == 6
    links = [("#top", None), ("mailto:x@y", None), ("//h.net/p", "http://h.net/p"), ("q", "http://g.net/q"), ("HTTP://A/b", "HTTP://A/b"), ("", None)]
    df = spark.createDataFrame([(a,) for a, _ in links], "a string").select(resolved(F.col("a"), F.lit("http://g.net/a")).alias("r"))
    assert [r.r for r in df.collect()] == [b for _, b in links]


@pytest.mark.parametrize("condition", ["false", "page_id in (7, 8)"])
def test_empty(spark, condition):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").filter(condition)
    judged = judge_urls(pages, alias_edges(pages), rules(spark)).collect()
    assert all(r.verdict == "allow" and r.rule is None and r.host == r.path == "" for r in judged)
