"""Per-crawl results: status, statistics, documents, summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.running import running
from linkloom.plans.crawl import CrawlRun

# How a crawl can end.
SUCCESS = "success"
MAX_PAGES_HIT = "max_pages_hit"
MAX_DEPTH_HIT = "max_depth_hit"
CANCELLED = "cancelled"
FAILED = "failed"
GOOD_ENDINGS = (SUCCESS, MAX_PAGES_HIT, MAX_DEPTH_HIT)

# How many URLs a report lists.
REPORT_VISITED = 10
REPORT_FAILED = 5


def page_cap(pages: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """The first ``max_pages`` rows of each crawl in the given order.

    ``limits`` has ``crawl_id, max_pages``. The running count spreads over many
    tasks when one crawl holds most of the rows.
    """
    counted = running(
        pages.join(limits.select("crawl_id", "max_pages"), "crawl_id"),
        ["crawl_id"],
        order,
        {"_ahead": ("sum", F.lit(1))},
        before=True,
    )
    return counted.filter("_ahead < max_pages").drop("_ahead", "max_pages")


def crawl_stats(run: CrawlRun) -> DataFrame:
    """One row per crawl: status, totals and timing. All from one grouped pass
    over the enqueued URLs, combined before the shuffle."""
    ok = (F.col("state") == "ok") & ~F.col("over")
    limits = run.requests.select(
        "crawl_id",
        "seed_url",
        "max_depth",
        F.col("started_at").cast("timestamp").alias("_started"),
    )
    # The deepest page decides whether the depth limit was met.
    totals = run.enqueued.groupBy("crawl_id").agg(
        F.count_if(ok).alias("total_pages"),
        F.count_if((F.col("state") == "failed") & ~F.col("over")).alias("failed_urls"),
        F.max(F.when(ok, F.col("depth"))).alias("deepest"),
        F.max("over").alias("capped"),
        F.min(F.when(ok, F.col("crawled_at"))).alias("_first"),
        F.max(F.when(ok, F.col("crawled_at"))).alias("finished_at"),
    )
    status = (
        F.when(F.col("total_pages").isNull(), F.lit(FAILED))
        .when(F.col("capped"), F.lit(MAX_PAGES_HIT))
        .when(F.col("deepest") == F.col("max_depth"), F.lit(MAX_DEPTH_HIT))
        .otherwise(F.lit(SUCCESS))
    )
    started = F.coalesce("_started", "_first")
    micros = F.unix_micros("finished_at") - F.unix_micros(started)
    return limits.join(totals, "crawl_id", "left").select(
        "crawl_id",
        "seed_url",
        status.alias("status"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        F.coalesce("failed_urls", F.lit(0)).alias("failed_urls"),
        F.coalesce("deepest", F.lit(0)).alias("max_depth_reached"),
        started.alias("started_at"),
        "finished_at",
        (micros / 1_000_000).alias("duration_seconds"),
    )


def crawl_status(run: CrawlRun) -> DataFrame:
    """``(crawl_id, status)``: the page cap outranks the depth limit."""
    return crawl_stats(run).select("crawl_id", "status")


def crawl_summary(run: CrawlRun) -> DataFrame:
    """``(crawl_id, summary)``: one line of text per crawl."""
    seconds = F.col("duration_seconds")
    duration = F.when(
        F.coalesce(seconds, F.lit(0.0)) != 0, F.format_string("%.1fs", seconds)
    ).otherwise(F.lit("ongoing"))
    # Fixed value: the format of the line.
    line = F.format_string(
        "seed=%s status=%s pages=%d failed=%d max_depth_reached=%d duration=%s",
        "seed_url",
        "status",
        "total_pages",
        "failed_urls",
        "max_depth_reached",
        duration,
    )
    return crawl_stats(run).select("crawl_id", line.alias("summary"))


def crawl_result_document(run: CrawlRun) -> DataFrame:
    """The nested document of each crawl, one row: scalars, sorted visited URLs,
    failed URLs and page records in discovery order.

    For crawls whose page cap keeps a document within a row, as the format is
    meant; ``sources.crawl_store`` keeps crawls of any size as tables.
    """
    entry = F.struct("url", "depth", "status_code", "links_found", "crawled_at", "error")
    pages = run.page_records().groupBy("crawl_id").agg(
        F.sort_array(F.collect_list("url")).alias("urls_visited"),
        F.sort_array(F.collect_list(F.struct("depth", "ord", entry.alias("entry")))).getField("entry").alias("pages"),
    )
    failed = run.failed().groupBy("crawl_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "ord", "url"))).getField("url").alias("urls_failed")
    )
    no_urls = F.array().cast("array<string>")
    no_pages = F.array().cast(pages.schema["pages"].dataType)
    return (
        crawl_stats(run)
        .join(pages, "crawl_id", "left")
        .join(failed, "crawl_id", "left")
        .select(
            "crawl_id",
            "seed_url",
            "status",
            F.lit(None).cast("string").alias("error"),
            F.col("total_pages").cast("int").alias("total_pages"),
            "max_depth_reached",
            F.coalesce("urls_visited", no_urls).alias("urls_visited"),
            F.coalesce("urls_failed", no_urls).alias("urls_failed"),
            F.coalesce("pages", no_pages).alias("pages"),
            "started_at",
            "finished_at",
            "duration_seconds",
        )
    )


def crawl_report(run: CrawlRun) -> DataFrame:
    """The listing of a crawl: the first visited URLs in sorted order and the
    first failures in discovery order, one row each, with the number of further
    visited URLs and whether the crawl ended well.

    A crawl without any URL has one row with its status and nothing listed. The
    ranks are limited, so each task passes on only a few rows per crawl.
    """
    by_url = W.partitionBy("crawl_id").orderBy("url")
    by_discovery = W.partitionBy("crawl_id").orderBy("depth", "ord")
    visited = (
        run.visited()
        .select("crawl_id", "url")
        .withColumn("position", F.row_number().over(by_url))
        .filter(F.col("position") <= REPORT_VISITED)
        .select("crawl_id", F.lit("visited").alias("section"), "position", "url")
    )
    failed = (
        run.failed()
        .withColumn("position", F.row_number().over(by_discovery))
        .filter(F.col("position") <= REPORT_FAILED)
        .select("crawl_id", F.lit("failed").alias("section"), "position", "url")
    )
    heads = crawl_stats(run).select(
        "crawl_id",
        "status",
        F.col("status").isin(*GOOD_ENDINGS).alias("ok"),
        F.greatest(F.col("total_pages") - REPORT_VISITED, F.lit(0)).alias("more_visited"),
    )
    return heads.join(visited.unionByName(failed), "crawl_id", "left").select(
        "crawl_id", "section", "position", "url", "status", "ok", "more_visited"
    )
