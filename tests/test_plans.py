"""Physical plans: what is read, what is moved."""

import re

import pytest

from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.operators.urls import domain_rollup
from linkloom.plans import crawl as crawl_plan
from linkloom.session import new_path, written
from linkloom.sources import derived as D
from linkloom.sources import runs as store
from test_rows import nodes

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text + "\n")]


def test_rollup_reads_urls_only(spark):
    assert read_columns(plan(domain_rollup(D.table(spark, SF, "pages")))) == [["url"]]


def test_listing_reads_scalars_only(spark):
    path = new_path(spark, "plans")
    store.save_runs(D.crawl_runs(spark, SF), path)
    reads = read_columns(plan(store.list_crawls(spark, path)))
    assert reads and all(sorted(r) == ["seed_url", "started_at", "status", "total_pages"] for r in reads)


def test_seed_lookup_prunes_buckets(spark):
    path = new_path(spark, "plans")
    store.save_runs(D.crawl_runs(spark, SF), path)
    seeds = D.crawl_runs(spark, SF).filter("crawl_id = 5").select("seed_url")
    text = plan(store.load_latest(spark, path, seeds))
    assert "dynamicpruning" in text


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def frontier(spark, urls, crawl_id=1):
    limits = [F.lit(3).alias("max_depth"), F.lit("shop.example.com/3/").alias("prefix"), F.lit(True).alias("respect_robots_txt")]
    return urls.select(
        F.lit(crawl_id).cast("long").alias("crawl_id"), "url", F.array().cast("array<int>").alias("ord"),
        F.lit(None).cast("string").alias("parent"), *limits,
    )


@pytest.fixture
def page_table(spark):
    requests = D.shop_requests(spark, SF).withColumns(
        {"url": F.col("seed_url"), "prefix": F.lit("shop.example.com/3/")}
    )
    table = crawl_plan._page_table(spark, D.shop_web(spark, SF), requests)
    yield spark.table(table)
    spark.sql(f"DROP TABLE {table}")


def exchanged(df):
    """Exchanges, each with the scans below it."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Exchange")]
    return [{m.nodeName() + m.simpleString(400) for m in nodes(n) if "Scan" in m.nodeName()} for n in found]


def test_links_are_read_where_the_level_lies(spark, page_table, no_broadcast):
    level = crawl_plan._looked_up(written(frontier(spark, page_table), "frontier"), page_table, None)
    crawl_plan._store(level, "linkloom_level_test", new_path(spark, "level"), ["url"])
    try:
        held = spark.table("linkloom_level_test").filter("state = 'ok'").select("crawl_id", "url", "ord")
        linked = crawl_plan._with_pages(held, page_table, ["links"], None)
        assert exchanged(linked) == [] and linked.filter("size(links) > 0").count() > 0
    finally:
        spark.sql("DROP TABLE linkloom_level_test")


@pytest.mark.parametrize("hot", [False, True])
def test_levels_do_not_move_the_page_table(spark, page_table, no_broadcast, hot):
    rows = written(frontier(spark, page_table), "frontier")
    urls = written(rows.limit(2).select("url", F.lit(3).alias("copies")), "hot") if hot else None
    looked_up = crawl_plan._looked_up(rows, page_table, None, urls)
    scans = {n.simpleString(2000) for n in nodes(looked_up._jdf.queryExecution().executedPlan()) if "Scan" in n.nodeName()}
    of_pages = [s for s in scans if "fetched_at" in s]
    assert of_pages and all("Bucketed: true" in s for s in of_pages)
    # A level is decided on narrow columns: no links are read.
    assert not any("links" in s for s in scans)
    if not hot:
        assert not any("linkloom_pages" in s for below in exchanged(looked_up) for s in below)
    assert looked_up.count() == rows.count()


def test_only_the_frontier_moves(spark, page_table, no_broadcast):
    queue = crawl_plan.Queue(spark)
    try:
        assert queue.append(frontier(spark, page_table.limit(20)), 0) == 20
        queue.append(frontier(spark, page_table.limit(30), 2), 1)
        found = written(frontier(spark, page_table).union(frontier(spark, page_table)), "children")
        children = found.groupBy("crawl_id", "url").agg(
            *[F.first(c).alias(c) for c in ("ord", "parent", "max_depth", "prefix", "respect_robots_txt")]
        )
        for last in (1, 2):
            fresh = queue.unseen(children, 1, last)
            # The grouped children are moved once and meet the queue in its buckets; its
            # files' statistics skip the crawls that have ended.
            below = exchanged(fresh)
            assert len(below) == 1 and not any("linkloom_queue" in s for s in below[0])
            text = plan(fresh)
            assert "GreaterThanOrEqual(crawl_id,1)" in text and "Bucketed: true" in text
            assert fresh.count() == page_table.count() - 20
        assert queue.level(1).count() == 30
    finally:
        spark.sql(f"DROP TABLE {queue.name}")


def test_link_graph_scans_each_body_once(spark):
    text = plan(catalog.QUERIES["link_graph"](spark, SF))
    assert text.count("regexp_extract_all(html") == 1
