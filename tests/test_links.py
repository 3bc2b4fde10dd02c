"""Link classification: literal cases on one page."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import links as L

PAGE = "https://lib.m.test/v2/shelf/"
SEED = "https://lib.m.test/v2/"


def classified(spark, html, seen=()):
    snap = spark.createDataFrame([(PAGE, 200, html)], "url string, status int, html string")
    requests = spark.createDataFrame([(1, SEED)], "crawl_id long, seed_url string")
    known = spark.createDataFrame([(1, u) for u in seen], "crawl_id long, url string")
    rows = L.classify_links(snap, requests, known if seen else None).orderBy("pos").collect()
    graph = L.link_graph(snap, requests).orderBy("pos").collect()
    return [(r.href, r.reason) for r in rows], [r.dst for r in graph]


@pytest.mark.parametrize(
    "html, reasons, targets",
    [
        (
            "<a href='https://lib.m.test/v2/p'>1</a><a href='../row/top.html'>2</a><a href='/v2/row/top.html'>3</a>",
            ["accepted", "accepted", "duplicate"], [SEED + "p", SEED + "row/top.html"],
        ),
        ("", [], []),
        ("<p>text</p><a id='w'>no href</a><a href=''>empty</a>", [], []),
        (
            "<a href='mailto:me@m.test'><a href='tel:49'><a href='javascript:go()'><a href='#mid'><a href='https://n.test/w'><a href='/v1/shelf/'>",
            ["non_http_scheme"] * 3 + ["fragment", "out_of_scope", "out_of_scope"], [],
        ),
        ("<a href='q'><a href='q#2'><a href='HTTPS://LIB.M.TEST/v2/shelf/q'>", ["accepted", "duplicate", "duplicate"], [PAGE + "q"]),
        ("<a href='/v2/c'><a href='/v2/b'><a href='/v2/a'>", ["accepted"] * 3, [SEED + "c", SEED + "b", SEED + "a"]),
        ("<base href='https://lib.m.test/v2/row/'><a href='top.html'>", ["accepted"], [SEED + "row/top.html"]),
        ("<base href='/v2/row/'><a href='top.html'>", ["invalid"], []),
        ("<base href=''><a href='top.html'><a href='https://lib.m.test/v2/z'>", ["invalid", "accepted"], [SEED + "z"]),
        ("<base href='http://[odd'><a href='top.html'>", ["unresolvable"], []),
        ("<a href='first.html'>", ["accepted"], [PAGE + "first.html"]),
        ("<a href='/v2/shelf/'>left open", ["accepted"], [PAGE]),
        ("<a href='/v2/note/Ask:W'><a href='p?at=9:15'><a href='//[odd/'>", ["non_http_scheme", "non_http_scheme", "unresolvable"], []),
    ],
)
def test_page(spark, html, reasons, targets):
    rows, graph = classified(spark, html)
    assert [r for _, r in rows] == reasons
    assert graph == targets


def test_known_targets(spark):
    html = "<a href='/v2/seen'><a href='/v2/new'><a href='/v2/seen'>"
    rows, _ = classified(spark, html, [SEED + "seen"])
    assert [r for _, r in rows] == ["visited", "accepted", "visited"]
    edges = spark.createDataFrame([(1, PAGE, SEED + "seen"), (1, PAGE, SEED + "new"), (2, PAGE, SEED + "seen")], "crawl_id long, src string, dst string")
    seen = spark.createDataFrame([(1, SEED + "seen")], "crawl_id long, url string")
    left = L.drop_visited(edges, seen).collect()
    assert {(r.crawl_id, r.dst) for r in left} == {(1, SEED + "new"), (2, SEED + "seen")}
    assert seen.count() == 1


def test_pages_out_of_every_scope_are_not_read(spark):
    snap = spark.createDataFrame(
        [("http://a/x/p", 200, "<a href=q>"), ("http://a/y/p", 200, "<a href=q>"), ("http://b/x/p", 200, "<a href=q>")],
        "url string, status int, html string",
    ).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    requests = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x/")], "crawl_id long, seed_url string")
    rows = L.adjacency(snap, requests, 4).collect()
    assert [(r.url, list(r.links)) for r in rows] == [("http://a/x/p", ["http://a/x/q"])]
