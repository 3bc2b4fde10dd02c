"""The crawl plan against a queue simulation on random webs."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fifo import simulate
from linkloom.operators import selection
from linkloom.plans import crawl as crawl_module
from linkloom.plans import report
from linkloom.plans.crawl import crawl

REQUEST = "crawl_id long, seed_url string, max_depth int, max_pages int, respect_robots_txt boolean"
START = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
ROBOTS = "domain string, fetched_at timestamp, status int, body string"


def snapshot(spark, pages):
    df = spark.createDataFrame(pages, "url string, status int, html string")
    return df.withColumn("fetched_at", F.lit("2026-01-02 03:04:05").cast("timestamp"))


def results(run):
    pages, failed = {}, {}
    for r in run.page_records().orderBy("crawl_id", "depth", "ord").collect():
        pages.setdefault(r.crawl_id, []).append((r.url, r.depth, r.links_found))
    for r in run.failed().orderBy("crawl_id", "depth", "ord").collect():
        failed.setdefault(r.crawl_id, []).append(r.url)
    status = {r.crawl_id: r.status for r in report.crawl_status(run).collect()}
    return pages, failed, status


def random_web(seed, n):
    rng = random.Random(seed)
    url = [f"http://h/s/{'ab'[i % 2]}/{i}" for i in range(n)]
    links = {}
    for i in range(n):
        hubs = [rng.randrange(5) for _ in range(rng.randint(0, 2))]
        links[url[i]] = [url[j] for j in hubs + [rng.randrange(n) for _ in range(rng.randint(0, 6))]]
    fetch = {u: rng.random() > 0.12 for u in url}
    blocked = {u for u in url if "/s/b/1" in u}
    rows = [
        (u, 200 if fetch[u] else 404, "".join(f'<a href="{t}#x">t</a>' for t in links[u]) + "." if fetch[u] else "")
        for u in url
        if rng.random() > 0.03 or fetch[u]
    ]
    return rng, url, links, fetch, blocked, rows


@pytest.mark.parametrize("small", [False, True])
def test_many_crawls_equal_queue(spark, monkeypatch, small):
    """``small``: caps cut by selection rounds, and pages that a few crawls name are copied."""
    if small:
        monkeypatch.setattr(selection, "SORTED", 3)
        monkeypatch.setattr(crawl_module, "HOT_ROWS", 2)
    rng, url, links, fetch, blocked, rows = random_web(5, 400)
    robots = spark.createDataFrame(
        [("h", None, 200, "User-agent: *\nDisallow: /s/b/1\nAllow: /s/")], ROBOTS
    )
    requests, expected = [], {}
    limits = [(0, 9999), (1, 9999), (2, 5), (3, 40), (9, 9999), (9, 60), (9, 1), (2, 9999), (1, 1), (4, 17)]
    for i, (depth, cap) in enumerate(limits):
        start = rng.choice([u for u in url if u not in blocked]) if i % 2 else "http://h/s/"
        respect = i % 3 != 0
        scope = start if start.endswith("/") else start + "/"
        requests.append((i, start, depth, cap, respect))
        inside = lambda t, s=start, p=scope: t == s or t.startswith(p)
        web = {u: [t for t in ts if inside(t)] for u, ts in {**links, "http://h/s/": url[:6]}.items()}
        ok = {**fetch, "http://h/s/": True}
        expected[i] = simulate(start, depth, cap, web, ok, blocked if respect else set())
    index = ("http://h/s/", 200, "".join(f"<a href={u}>" for u in url[:6]))
    run = crawl(spark.createDataFrame(requests, REQUEST), snapshot(spark, rows + [index]), robots, START)
    pages, failed, status = results(run)
    for i, (want_pages, want_failed, want_status) in expected.items():
        assert pages.get(i, []) == want_pages, (i, limits[i])
        assert failed.get(i, []) == want_failed, (i, limits[i])
        assert status[i] == want_status, (i, limits[i])


def test_literal_cases(spark):
    seed = "https://lib.m.test/v2/"
    html = "<a href='/v2/shelf/'>t</a><a href='/v2/row/'>l</a>"
    rows = [(seed, 200, html), (seed + "shelf/", 200, "x"), (seed + "row/", 404, "")]
    requests = [
        (1, seed, 0, 10, False),  # depth 0: the seed only
        (2, seed, 3, 1, False),  # cap 1
        (3, seed, 2, 10, True),  # robots denies all
        (4, "https://lib.m.test/v1/", 2, 10, False),  # seed not stored
        (5, "https://lib.m.test/v2#x", 2, 10, False),  # seed without slash
        (6, "http://[bad/", 2, 10, False),  # no canonical seed
        (7, "https://lib.m.test/v2/row", 1, 10, False),
    ]
    robots = spark.createDataFrame([("lib.m.test", None, 200, "User-agent: *\nDisallow: /")], ROBOTS)
    run = crawl(spark.createDataFrame(requests, REQUEST), snapshot(spark, rows), robots, START)
    pages, failed, status = results(run)
    assert pages == {1: [(seed, 0, 0)], 2: [(seed, 0, 2)]}
    assert failed == {4: ["https://lib.m.test/v1/"], 5: ["https://lib.m.test/v2"], 7: [seed + "row"]}
    assert status == {
        1: "max_depth_hit", 2: "max_pages_hit", 3: "success", 4: "success", 5: "success", 6: "failed", 7: "success",
    }
    docs = {r.crawl_id: r for r in report.crawl_result_document(run).collect()}
    assert len(docs) == 7 and docs[3].urls_visited == [] and docs[3].pages == [] and docs[4].urls_failed
    # A crawl that robots.txt keeps from every page is reported too.
    blocked = [r for r in report.crawl_report(run).collect() if r.crawl_id == 3]
    assert [(r.section, r.url, r.status, r.ok) for r in blocked] == [(None, None, "success", True)]
    summary = {r.crawl_id: r.summary for r in report.crawl_summary(run).collect()}
    assert summary[1] == f"seed={seed} status=max_depth_hit pages=1 failed=0 max_depth_reached=0 duration=ongoing"


def test_documents_and_listings_agree(spark):
    _, url, links, fetch, _, rows = random_web(9, 120)
    index = ("http://h/s/", 200, "".join(f"<a href={u}>" for u in url[:6]))
    requests = [(1, "http://h/s/", 9, 999, False), (2, "http://h/s/", 2, 20, False)]
    run = crawl(spark.createDataFrame(requests, REQUEST), snapshot(spark, rows + [index]), None, START)
    whole = {r.crawl_id: r for r in report.crawl_result_document(run).collect()}
    for doc in whole.values():
        assert doc.urls_visited == sorted(doc.urls_visited) and len(doc.pages) == doc.total_pages
        assert sorted(p.url for p in doc.pages) == doc.urls_visited
    listed = report.crawl_report(run).filter("section = 'visited'").orderBy("crawl_id", "position").collect()
    for crawl_id, doc in whole.items():
        mine = [r for r in listed if r.crawl_id == crawl_id]
        assert [r.url for r in mine] == doc.urls_visited[:10]
        assert {r.more_visited for r in mine} == {max(doc.total_pages - 10, 0)}


def test_a_page_that_very_many_crawls_name(spark, monkeypatch):
    """Its rows come to many tasks, with the same result."""
    monkeypatch.setattr(crawl_module, "HOT_ROWS", 500)
    spread = []
    look_up = crawl_module._with_pages

    def watched(rows, pages, columns, hot):
        found = look_up(rows, pages, columns, hot)
        if hot is not None and "ok" in columns:
            tasks = found.filter("url = 'http://h/hub'").groupBy(F.spark_partition_id()).count().collect()
            spread.append([r["count"] for r in tasks])
        return found

    monkeypatch.setattr(crawl_module, "_with_pages", watched)
    requests = spark.range(6_000).selectExpr(
        "id AS crawl_id", "concat('http://h/', if(id % 2 = 0, 'hub', concat('s', id))) AS seed_url", "1 AS max_depth", "10 AS max_pages"
    )
    pages = [("http://h/hub", 200, "<a href=/hub/x>")] + [(f"http://h/s{k}", 200, "leaf") for k in range(1, 40, 2)]
    run = crawl(requests, snapshot(spark, pages), None, START)
    states = {(r.state, r.depth): r["count"] for r in run.enqueued.groupBy("state", "depth").count().collect()}
    assert states == {("ok", 0): 3_020, ("failed", 0): 2_980, ("failed", 1): 3_000}
    assert spread and len(spread[0]) > 2 and max(spread[0]) < 2_000
