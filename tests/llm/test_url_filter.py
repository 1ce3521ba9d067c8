from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.llm import queries, sql
from foldsmith.llm.graph import connected_components
from foldsmith.llm.url_filter import canonical_of, judge_urls, link_edges
from tests.compare import difference
from tests.llm.tables import connect

LINK = '<html><head><LINK href="{0}" rel="canonical"></head>'
REFRESH = '<meta http-equiv="refresh" content="0; url={0}">'
PAGES = [
    (1, "http://a.net/x", ""), (2, "https://Good.Org/en/1", LINK.format("http://a.net/x")), (3, "http://other.example.org/fr/2", LINK.format("https://good.org/en/1")),
    (4, "https://www.mirror.com/q?utm_source=f&id=3#top", REFRESH.format("/landing")), (5, "http://mirror.com/landing/", LINK.format("http://good.org/en/1")),
    (6, "http://example.net/en/5", LINK.format("http://example.net/de/5")), (7, "http://example.net/de/5", ""), (8, "http://example.com/de/", None),
    (9, "http://notexample.com/de/", ""), (10, "no scheme", "x"), (11, None, LINK.format("http://a.net/x")), (12, "http://a.net", ""), (13, "http://a.net?x=/", ""),
    (14, "", None), (15, "ftp://b.net/://c", ""), (1, "http://a.net/x", ""), (None, "http://x.org/fr/9", LINK.format("rel")), (17, "http://x.org/fr/rel", ""),
    (18, "http://mirror.com/q?id=3", ""), (19, "http://lone.com/1", LINK.format("//lone.com/2")),
]


def pages(spark, rows=None):
    return spark.createDataFrame([(*r, "extra", 1) for r in (PAGES if rows is None else rows)], "page_id long, url string, html string, rule string, component int")


def judged(spark, rows=None):
    return judge_urls(pages(spark, rows), spark.sql(f"SELECT * FROM {queries.RULES}"))


def test_matches_sql(spark):
    assert difference(judged(spark), connect(pages=pages(spark)), sql.URL_FILTER) is None


def test_references_match_sql(spark):
    """Entities, dot segments, queries, fragments, other schemes and urls without one: components and verdicts of both."""
    hrefs = ["/x?a=1&amp;b=2", "/x?a=1&#38;b=&quot;", "../x", "./x", "../../../x/./y/..", "?x=1", "e?u=../f", "/go?u=http://b.com/", "//b.com/x", "http://b.com/x", "#top",
             "mailto:me", "/a/..", "..", "http:&#47;&#x2F;a.net/x", "&amp;lt;", "//a.net/./y", ".", "/./../z", "a/b/../c/"]
    rows = [(i, f"http://h{i % 5}.com/b/c/d?q={i}", (LINK if i % 2 else REFRESH).format(h)) for i, h in enumerate(hrefs * 2)]
    rows += [(100 + i, u, LINK.format(h)) for i, (u, h) in enumerate((u, h) for u in ("no scheme", "") for h in hrefs)]
    rows += [(200, "http://a.net/x", ""), (201, "http://h1.com/b/x", LINK.format("http://a.net/x")), (202, "http://b.com/x", LINK.format("http://a.net/y"))]
    found = judged(spark, rows)
    assert difference(found, connect(pages=pages(spark, rows)), sql.URL_FILTER) is None
    verdicts = [r["verdict"] for r in found.collect()]
    assert 5 < verdicts.count("block") < len(verdicts)


def test_blocks_reach_aliases_and_allow_stands(spark):
    found = {r["page_id"]: r for r in judged(spark).collect()}
    assert found[2]["verdict"] == "block" and found[2]["rule"] is None  # canonical link to a blocked page
    assert found[3]["verdict"] == "allow" and found[3]["rule"] == "org/fr/"  # own allow, though its component is blocked
    assert found[4]["verdict"] == found[5]["verdict"] == found[18]["verdict"] == "block"  # over a redirect, then a link
    assert found[6]["verdict"] == "allow" and found[7]["verdict"] == "block"
    assert found[9]["verdict"] == found[19]["verdict"] == found[10]["verdict"] == found[11]["verdict"] == "allow"
    assert found[12]["rule"] is None and found[13]["rule"] is None and found[13]["path"] == ""
    assert found[15]["host"] == "b.net" and found[15]["path"] == "/://c"


def test_given_redirects(spark):
    moves = spark.createDataFrame([("http://lone.com/2", "http://a.net/x"), (None, "http://a.net/x")], "source string, target string")
    found = judge_urls(pages(spark), spark.sql(f"SELECT * FROM {queries.RULES}"), moves).collect()
    assert {r["verdict"] for r in found if r["page_id"] == 19} == {"block"}


def test_references_mean_what_a_browser_takes_them_for(spark):
    url = "http://a.com/b/c/d?q=1"
    cases = {"/x?a=1&amp;b=2": "a.com/x?a=1&b=2", "/x?a=1&#38;b=&quot;": 'a.com/x?a=1&b="', "../x": "a.com/b/x", "./x": "a.com/b/c/x", "../../../x/./y/..": "a.com/x",
             "?x=1": "a.com/b/c/d?x=1", "e?u=../f": "a.com/b/c/e?u=../f", "/go?u=http://b.com/": "a.com/go?u=http://b.com/", "//b.com/x": "b.com/x",
             "http://b.com/x": "b.com/x", "#top": "a.com/b/c/d?q=1", "mailto:me": None, "/a/..": "a.com", "..": "a.com/b"}
    rows = [(i, f"{url}#{i}", LINK.format(h)) for i, h in enumerate(cases)]
    rows += [(100, "no scheme", LINK.format("http://b.com/x")), (101, "none", LINK.format("rel")), (102, None, LINK.format("http://b.com/x"))]
    found = {r["source"]: r["f"] for r in link_edges(pages(spark, rows)).withColumn("f", canonical_of(F.col("target"))).collect()}
    want = {f"{url}#{i}": form for i, form in enumerate(cases.values()) if form} | {"no scheme": "b.com/x"}
    assert found == want


def test_blocks_reach_aliases_over_written_references(spark):
    rows = [(1, "http://a.net/x?a=1&b=2", ""), (2, "http://m.com/1", LINK.format("http://a.net/x?a=1&amp;b=2")), (3, "alias", LINK.format("http://a.net/x?a=1&amp;b=2")),
            (4, "http://m.com/d/e/4", LINK.format("../../1"))]
    assert {r["page_id"] for r in judged(spark, rows).collect() if r["verdict"] == "block"} == {1, 2, 3, 4}


def test_empty(spark):
    assert judged(spark, []).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(200, 400)] + [(5, 5), (None, 3), (7, 6), (900, 901), (900, 901)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, **{i: 200 for i in [*range(200, 400), 1000]}, 900: 900, 901: 900}
