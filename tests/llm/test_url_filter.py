import random

from pyspark.sql import functions as F

from lineamix.llm.components import components
from lineamix.llm.url_filter import address, filter_urls, host, match_rules, page_links, path

PAGES = "page_id bigint, url string, html string"


def test_parts(spark, rows):
    urls = [("HTTP://EXAMPLE.com/A?b#c",), ("x",), (None,), ("a://É.Net",), ("a://h?q://z/p",), ("://h#f/p",), ("",)]
    got = [tuple(r) for r in spark.createDataFrame(urls, "url string").select(
        host(F.col("url")), path(F.col("url")), address(F.col("url"))).collect()]
    assert got == [("example.com", "/A", "example.com/A?b"), ("", "", None), ("", "", None), ("É.net", "", "É.net"),
                   ("h", "", "h?q://z/p"), ("h", "", "h"), ("", "", None)]


def test_longest_rule(spark, rows):
    rules = spark.createDataFrame([("com/", "allow"), ("a.com/x", "block"), ("a.com/xy/", "allow"), ("bad", "block"), ("com/", "block")], "rule string, verdict string")
    places = spark.createDataFrame([("b.a.com", "/xz"), ("a.com", "/xy/1"), ("aa.com", "/x"), ("com", "/"), ("com", ""), ("net", "/")], "host string, path string")
    assert rows(match_rules(places, rules)) == [
        ("a.com", "/xy/1", "a.com/xy/", "allow"), ("aa.com", "/x", "com/", "allow"), ("b.a.com", "/xz", "a.com/x", "block"), ("com", "/", "com/", "allow")]


def test_decisions_reach_aliases(spark, rows):
    pages = spark.createDataFrame([
        (1, "http://bad.net/1", '<LINK href="//alias.org/a?x=1&amp;y=2" rel=canonical>'),
        (2, "https://alias.org/a?x=1&y=2#f", '<meta http-equiv="refresh" content="0; URL=/b">'),
        (3, "http://alias.org/b", None),
        (4, "http://good.net/1", '<link rel="canonical" href="http://bad.net/2">'),
        (5, "http://third.org/", '<link rel="canonical" href="http://good.net/1"><link rel="canonical" href="http://no.org/">'),
        (6, "http://alone.org/", '<link rel="stylesheet" href="http://bad.net/1">'),
        (7, None, '<link rel="canonical" href="http://bad.net/1">'), (8, "none", ""), (3, "http://alias.org/b", None),
        (9, "http://bad.net/2", ""), (10, "http://alias.org/a", ""),
    ], PAGES).withColumn("host", F.lit("clash")).withColumn("component", F.lit(0))
    rules = spark.createDataFrame([("bad.net/", "block"), ("good.net/", "allow")], "rule string, verdict string")
    got = {r.page_id: r.verdict for r in filter_urls(pages, page_links(pages), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert filter_urls(pages, page_links(pages), rules).count() == 11
    none = pages.limit(0)
    assert filter_urls(none, page_links(none), rules).count() == 0


def test_components_against_union_find(spark, rows):
    pick = random.Random(3)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)] + [(0, i) for i in range(400, 480)]
    edges += [(i, i + 1) for i in range(600, 660)] + [(5, None), (None, 7), (700, 700)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        else:
            find(a if a is not None else b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
