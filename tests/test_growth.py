"""What grows with the tables stays off the driver, and no task holds a whole document."""

import json
from datetime import datetime, timezone
from urllib.parse import urljoin

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import links
from linkloom.plans import crawl as crawl_plan
from linkloom.session import new_path, written
from linkloom.sources import crawl_store
from linkloom.sources.snapshot import page_snapshot

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
REQUEST = "crawl_id long, seed_url string, max_depth int, max_pages int"


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def snapshot(spark, rows):
    df = spark.createDataFrame([(u, 200, h) for u, h in rows], "url string, status int, html string")
    return df.withColumn("fetched_at", F.lit(None).cast("timestamp"))


def test_pages_and_crawls_are_not_broadcast(spark):
    requests = spark.createDataFrame([(k, f"http://h{k % 3}/s{k}", 1, 9) for k in range(200)], REQUEST)
    web = snapshot(spark, [(f"http://h{k % 3}/s{k}", "<a href=x>") for k in range(200)] + [("http://other/", "x")])
    adjacent = links.adjacency(web, requests, 4)
    # The domains are sent, not a row per scope or page.
    assert text(adjacent).count("BroadcastExchange") == 1 and "Generate" not in text(adjacent)
    assert adjacent.count() == 200
    pages = written(adjacent, "pages")
    frontier = written(
        requests.select(
            "crawl_id", F.col("seed_url").alias("url"), F.array().cast("array<int>").alias("ord"), F.lit(None).cast("string").alias("parent"),
            "max_depth", F.lit("h").alias("prefix"), F.lit(False).alias("respect_robots_txt"),
        ),
        "frontier",
    )
    level = crawl_plan._looked_up(frontier, pages, None)
    assert "BroadcastExchange" not in text(level) and level.filter("state = 'ok'").count() == 200
    held = written(level, "level")
    tally = written(crawl_plan._tally(held, requests.select("crawl_id", "max_pages"), None, 0), "tally")
    spent = tally.select("crawl_id", "n_earlier")
    assert "BroadcastExchange" not in text(crawl_plan._tally(held, written(requests, "r").select("crawl_id", "max_pages"), spent, 1))


def test_seeds_outside_their_own_scope(spark):
    """A seed that ends with blanks is found only where another crawl's scope holds its page."""
    requests = [(k, f"http://h/s{k}/", 0, 9) for k in range(40)] + [(50, "http://h/x  ", 0, 9), (51, "http://h/s1/y  ", 0, 9)]
    web = snapshot(spark, [(f"http://h/s{k}/", "x") for k in range(40)] + [("http://h/x", "x"), ("http://h/s1/y", "y")])
    for kept in (requests, requests[38:] + requests[1:2]):
        run = crawl_plan.crawl(spark.createDataFrame(kept, REQUEST), web, None, START)
        states = {r.crawl_id: r.state for r in run.enqueued.collect()}
        assert states == {k: "failed" if k == 50 else "ok" for k, *_ in kept}


def test_levels_read_sorted_buckets(spark, monkeypatch):
    """Pages and levels are not sorted again at every level."""
    sorts, expand = [], crawl_plan._expand

    def watched(linked):
        sorts.append(text(linked).count("Sort ["))
        return expand(linked)

    monkeypatch.setattr(crawl_plan, "_expand", watched)
    web = snapshot(spark, [("http://h/", "<a href=/a><a href=/b>"), ("http://h/a", "<a href=/c>"), ("http://h/c", "x")])
    before = spark.conf.get(crawl_plan._SORTED_FILES)
    run = crawl_plan.crawl(spark.createDataFrame([(1, "http://h/", 5, 99)], REQUEST), web, None, START)
    assert {r.url: r.state for r in run.enqueued.collect()} == {
        "http://h/": "ok", "http://h/a": "ok", "http://h/b": "failed", "http://h/c": "ok"
    }
    assert sorts and set(sorts) == {0}
    assert spark.conf.get(crawl_plan._SORTED_FILES) == before


def test_documents_are_read_in_blocks(spark):
    urls = ["http://m.test/"] + [f"http://m.test/{k}ü" for k in range(300)]
    body = "".join(f'<a href="{u}">' for u in urls)
    pages = spark.createDataFrame([(k, u, body if not k else "x") for k, u in enumerate(urls)], "page_id long, url string, html string")
    run = crawl_plan.crawl(spark.createDataFrame([(1, urls[0], 9, 999)], REQUEST), page_snapshot(pages), None, START)
    path = new_path(spark, "documents")
    crawl_store.write_documents(run, path)
    options = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1"}
    try:
        for name, value in options.items():
            spark.conf.set(name, value)
        blocks = crawl_store.stored_lines(spark, path).groupBy("part", "block").count().collect()
        rows = crawl_store.read_documents(spark, path).orderBy("line_no").collect()
    finally:
        for name in options:
            spark.conf.unset(name)
    assert len(blocks) > 5 and max(b["count"] for b in blocks) < len(rows) / 3
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
    found = "\n".join(r.line for r in rows)
    assert found == json.dumps(json.loads(found), indent=2, ensure_ascii=False) and found.count("links_found") == 301


def test_plain_bases_and_spelled_hosts(spark):
    bases = ["http://h.test/a/b", "https://h.test:80/", "http://h.test", "HTTP://H.test/a", "http://h.test/a;p/b?q=1", ""]
    hrefs = ["x", "/x", "?q=2", "//O.test/p", "HTTP://H.Test/A/../b", "Https://o.TEST:8/x", "hTTp://h.test/x;p", "HTTP://H.test?a=1"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = {(r.b, r.h): r.u for r in df.withColumn("u", U.resolve_url(F.col("b"), F.col("h"))).collect()}
    joined = spark.createDataFrame([(b, h, urljoin(b, h)) for b in bases for h in hrefs], "b string, h string, j string")
    want = {(r.b, r.h): r.u for r in joined.withColumn("u", U.canonical_url(F.col("j"))).collect()}
    assert got == want
