"""Streaming discovery: equal to batch whatever arrives when, and how often."""

from pyspark.sql import functions as F

from linkloom.operators.links import link_graph
from linkloom.session import new_path
from linkloom.sources.derived import host_requests
from linkloom.sources.snapshot import page_snapshot
from linkloom.streaming.discovery import discovered_links, page_stream, page_versions, write_versions


def batch_links(pages, requests):
    return link_graph(page_snapshot(pages), requests).select("crawl_id", F.col("dst").alias("url")).distinct()


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_stream_equals_batch_after_every_arrival(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    requests = host_requests(given)
    # Every URL again with a larger and a smaller id and other links, and one row twice.
    later = given.select((F.col("page_id") + 10_000).alias("page_id"), F.concat("url", F.lit("#x")).alias("url"), F.lit('<a href="/later">').alias("html"))
    earlier = given.filter("page_id % 3 = 0").select((-F.col("page_id") - 1).alias("page_id"), "url", F.lit('<a href="/earlier"><a href="/e2">').alias("html"))
    folder, out, state = (new_path(spark, n) for n in ("in", "out", "state"))

    def step():
        write_versions(page_versions(page_stream(spark, folder)), out, state).awaitTermination()
        return discovered_links(spark, out, requests)

    arrivals = [later.filter("page_id % 2 = 0"), given, earlier.union(given.limit(3)), later]
    for some in arrivals:
        some.write.mode("append").parquet(folder)
        found = step()
        assert same(found, batch_links(spark.read.parquet(folder), requests))
    assert found.filter("url LIKE '%/earlier'").count() and not found.filter("url LIKE '%/later'").count()
    n_files = len(spark.read.parquet(out).inputFiles())
    assert same(step(), found) and len(spark.read.parquet(out).inputFiles()) == n_files


def test_settings_are_left_alone(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    pages = page_stream(spark, "/root/testdata/sf0.001/pages.parquet/")
    write_versions(page_versions(pages), new_path(spark, "out")).awaitTermination()
    assert spark.conf.get(key, None) == before


def test_folders_of_any_name_and_files_give_the_same(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    requests, found = host_requests(given), []
    folders = [new_path(spark, "table") + end for end in ("/pages.parquet", "/a[b]{c}*")]
    for folder in folders:
        given.write.parquet(folder)
    for path in (*folders, folders[0] + "/", "/root/testdata/sf0.001/pages.parquet"):
        out = new_path(spark, "out")
        write_versions(page_versions(page_stream(spark, path)), out).awaitTermination()
        found.append(discovered_links(spark, out, requests).count())
    assert len(set(found)) == 1 and found[0] > 0


def test_nothing_has_arrived(spark):
    requests = spark.createDataFrame([(1, "http://h/")], "crawl_id long, seed_url string")
    assert discovered_links(spark, new_path(spark, "none"), requests).isEmpty()
