from sparkbars.llm import urls

from .conftest import by_id


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def canonical(href):
    return f'<html><head><link rel="canonical" href="{href}"></head></html>'


def test_rules_hosts_and_paths(spark):
    rows = [(1, "http://www.Example.ORG/es/1", None), (2, "https://example.org/en/12?x=/es/", ""), (3, "http://a.org", ""),
            (4, "http://a.com/de/x#/fr/", ""), (5, "http://a.com/fr/x", ""), (6, "http://notcom/de/", ""), (7, None, None),
            (8, "no scheme.com/de/", ""), (9, "http://example.org/", ""), (10, "http://com/de/", "")]
    got = by_id(urls.judge(page(spark, rows)), "page_id")
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: ("com/de/", "block"),
        5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow"), 10: ("com/de/", "block")}
    assert (got[1].host, got[1].path, got[3].path, got[7].host, got[8].host) == ("www.example.org", "/es/1", "", "", "")


def test_blocks_reach_aliases_and_allows_win(spark):
    rows = [(1, "http://x.net/a", canonical("http://x.net/b")), (2, "http://x.net/b", '<meta http-equiv="refresh" content="0; url=http://q.com/de/1">'),
            (3, "http://y.net/a", canonical("http://q.com/de/2")), (4, "http://z.net/a#top", canonical("/c")), (5, "http://z.net/c", canonical("http://q.com/de/2")),
            (6, "http://v.net/a", canonical("http://q.com/de/3")), (7, "http://v.net/b", canonical("http://v.net/a")),
            (8, "http://free.org/x", canonical("http://v.net/b")), (9, "http://lone.net/", canonical("http://lone.net/"))]
    got = by_id(urls.judge(page(spark, rows)), "page_id")
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5}
    assert got[6].verdict == got[7].verdict == "allow"  # an allowed member of the class
    assert got[4].by_alias and not got[8].by_alias and got[8].rule == "org/"


def test_redirect_log_repeats_and_empty(spark):
    rows = [(1, "http://x.net/a", None), (1, "http://x.net/a", None), (2, "http://x.net/b", None)]
    log = spark.createDataFrame([("http://x.net/a", "http://q.com/de/"), ("http://x.net/a", "http://q.com/de/"), (None, "http://x.net/b")], "u string, v string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(page(spark, rows).selectExpr("*", "1 AS host", "2 AS rule"), edges=log).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow")]
    assert urls.judge(page(spark, [])).count() == 0


def test_native_plan(spark):
    plan = urls.judge(page(spark, [(1, "http://x.net/a", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow") and "Cartesian" not in plan and "NestedLoop" not in plan
