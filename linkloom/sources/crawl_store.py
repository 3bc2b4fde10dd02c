"""Finished crawls in the run store: one header row per run, pages and failures as tables,
and documents written as text.

No row holds a whole crawl, so runs of any size are saved, listed, loaded and
deleted like others. Details are written before the header that makes them visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.running import running
from linkloom.plans.crawl import CrawlRun
from linkloom.plans.report import crawl_stats
from linkloom.session import written
from linkloom.sources import runs as store

_DETAILS = {
    "run_pages": "url STRING, depth INT, status_code INT, links_found INT, crawled_at TIMESTAMP, error STRING, "
    "ord ARRAY<INT>, run_id STRING",
    "run_failed": "url STRING, depth INT, ord ARRAY<INT>, run_id STRING",
}


def save_crawl(run: CrawlRun, path: str) -> DataFrame:
    """Save every crawl of a job; one row with ``saved, failed, total``."""
    heads = crawl_stats(run).select(
        "crawl_id",
        "seed_url",
        "status",
        F.lit(None).cast("string").alias("error"),
        F.col("total_pages").cast("int").alias("total_pages"),
        "max_depth_reached",
        *[
            F.lit(None).cast(store.RUN_TYPES[name]).alias(name)
            for name in ("urls_visited", "urls_failed", "pages")
        ],
        "started_at",
        "finished_at",
        "duration_seconds",
        F.expr("uuid()").alias("run_id"),
    )
    # The ids must stay what they are in all three tables.
    heads = written(heads, "heads")
    ids = heads.select("crawl_id", "run_id")
    for name, rows in (("run_pages", run.page_records()), ("run_failed", run.failed())):
        rows.join(ids, "crawl_id").drop("crawl_id").write.mode("append").parquet(f"{path}/{name}")
    return store.save_runs(heads, path)


def latest_pages(spark: SparkSession, path: str, seeds: DataFrame | None = None) -> DataFrame:
    """Page rows of the newest run of each seed."""
    return _details(spark, path, "run_pages", seeds)


def latest_failed(spark: SparkSession, path: str, seeds: DataFrame | None = None) -> DataFrame:
    """Failed URLs of the newest run of each seed."""
    return _details(spark, path, "run_failed", seeds)


def _details(spark: SparkSession, path: str, name: str, seeds: DataFrame | None) -> DataFrame:
    newest = store.latest_ids(spark, path, seeds)
    return store.read_or_empty(spark.read, _DETAILS[name], f"{path}/{name}").join(newest, "run_id").drop("run_id")


# -- documents ------------------------------------------------------------------

_HEAD, _VISITED, _TO_FAILED, _FAILED, _TO_PAGES, _PAGES, _TAIL = range(7)
_ORDER = ["section", "depth", "ord", "url"]

# Most blocks of documents that may be sent to every task.
SENT_BLOCKS = 50_000


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    array = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(array, F.lit(2), F.length(array) - 2))


def _seconds(micros: Column) -> Column:
    """Seconds as the shortest decimal number."""
    whole = F.regexp_replace((micros / 1_000_000).cast("decimal(26,6)").cast("string"), "(?<=\\d)0{1,5}$", "")
    tiny = F.concat(
        F.regexp_replace((micros / F.when(micros < 10, 1).otherwise(10)).cast("string"), r"\.0$", ""),
        F.when(micros < 10, F.lit("e-06")).otherwise(F.lit("e-05")),
    )
    return F.when(micros.isNull(), F.lit("null")).when(micros.between(1, 99), tiny).otherwise(whole)


def document_fragments(run: CrawlRun) -> DataFrame:
    """``(crawl_id, filename, section, depth, ord, url, text)``: the lines of every run's document.

    In the order of ``section, depth, ord, url`` the texts of a run, one below the other, are its JSON
    document with an indent of two. Lists are rows of their own, so no row grows with a crawl.
    """
    heads = crawl_stats(run).withColumn("filename", store.run_filename(F.col("seed_url"), F.col("started_at")))
    place = F.struct("depth", "ord", "url")
    visited, failed = run.visited(), run.failed()
    # The last row of each list has no comma behind it.
    ends = visited.groupBy("crawl_id").agg(F.max("url").alias("last_url"), F.max(place).alias("last_page"))
    heads = heads.join(ends, "crawl_id", "left").join(
        failed.groupBy("crawl_id").agg(F.max(place).alias("last_failed")), "crawl_id", "left"
    )
    heads = written(heads, "document-heads")

    def opened(name: str, last: str) -> Column:
        return F.when(F.col(last).isNull(), F.lit(f'  "{name}": [],')).otherwise(F.lit(f'  "{name}": ['))

    def closed(last: str, then: Column) -> Column:
        return F.when(F.col(last).isNull(), then).otherwise(F.concat(F.lit("  ],\n"), then))

    time = {c: _quoted(store.iso_time(F.col(c))) for c in ("started_at", "finished_at")}
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    frame = {
        _HEAD: F.concat_ws(
            "\n",
            F.concat(F.lit('{\n  "seed_url": '), _quoted(F.col("seed_url")), F.lit(",")),
            F.concat(F.lit('  "status": '), _quoted(F.col("status")), F.lit(',\n  "error": null,')),
            F.concat(F.lit('  "total_pages": '), F.col("total_pages").cast("string"), F.lit(",")),
            F.concat(F.lit('  "max_depth_reached": '), F.col("max_depth_reached").cast("string"), F.lit(",")),
            opened("urls_visited", "last_url"),
        ),
        _TO_FAILED: closed("last_url", opened("urls_failed", "last_failed")),
        _TO_PAGES: closed("last_failed", opened("pages", "last_page")),
        _TAIL: closed(
            "last_page",
            F.concat(
                F.lit('  "started_at": '), time["started_at"],
                F.lit(',\n  "finished_at": '), time["finished_at"],
                F.lit(',\n  "duration_seconds": '), _seconds(micros), F.lit("\n}"),
            ),
        ),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("section"), text.alias("text")) for k, text in frame.items()])
    lines = heads.select("crawl_id", "filename", F.explode(parts).alias("part"))
    lines = lines.select(
        "crawl_id", "filename", "part.section", F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("ord"), F.lit("").alias("url"), "part.text",
    )

    def listed(rows: DataFrame, section: int, own: Column, last: str, text: Column, by_url: bool = False) -> DataFrame:
        with_last = rows.join(heads.select("crawl_id", "filename", last), "crawl_id")
        comma = F.when(own == F.col(last), F.lit("")).otherwise(F.lit(","))
        return with_last.select(
            "crawl_id", "filename", F.lit(section).alias("section"),
            (F.lit(0) if by_url else F.col("depth")).alias("depth"),
            (F.array().cast("array<int>") if by_url else F.col("ord")).alias("ord"), "url",
            F.concat(text, comma).alias("text"),
        )

    url = F.concat(F.lit("    "), _quoted(F.col("url")))
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("null"))
    page = F.concat(
        F.lit('    {\n      "url": '), _quoted(F.col("url")),
        F.lit(',\n      "depth": '), F.col("depth").cast("string"),
        F.lit(',\n      "status_code": '), status,
        F.lit(',\n      "links_found": '), F.col("links_found").cast("string"),
        F.lit(',\n      "crawled_at": '), _quoted(store.iso_time(F.col("crawled_at"))),
        F.lit(',\n      "error": '), _quoted(F.col("error")), F.lit("\n    }"),
    )
    return (
        lines.unionByName(listed(visited, _VISITED, F.col("url"), "last_url", url, by_url=True))
        .unionByName(listed(failed, _FAILED, place, "last_failed", url))
        .unionByName(listed(run.page_records(), _PAGES, place, "last_page", page))
    )


def write_documents(run: CrawlRun, path: str) -> None:
    """Write each run's document as text below ``crawl_id=.../filename=...``.

    Fragments are range-sorted by run and place, so a run is one file unless it spans partitions;
    then its files, in the order of their names, are the document. No task holds a run.
    """
    order = ["crawl_id", "filename", *_ORDER]
    # A name that might be null would make the writer sort the fragments anew.
    named = document_fragments(run).withColumn("filename", F.coalesce("filename", F.lit("unnamed.json")))
    fragments = named.repartitionByRange(*order).sortWithinPartitions(*order)
    fragments.select("crawl_id", "filename", "text").write.partitionBy("crawl_id", "filename").text(path)


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(crawl_id, filename, part, block, place, value)``: the lines of the documents below ``path``, written.

    Files are read in blocks, so neither a row nor a task holds one. ``place`` counts the lines of a block
    in their order, from any number; it is written so that it stays what it is.
    """
    lines = spark.read.schema("value STRING, crawl_id BIGINT, filename STRING").text(path, lineSep="\n")
    return written(
        lines.select(
            "crawl_id",
            "filename",
            F.col("_metadata.file_name").alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        ),
        "document-lines",
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(crawl_id, filename, line_no, line)`` of the documents written, line by line."""
    lines = stored_lines(spark, path)
    block = ["crawl_id", "part", "block"]
    sizes = lines.groupBy(*block).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = written(running(sizes, ["crawl_id"], ["part", "block"], {"ahead": ("sum", F.col("n"))}, before=True).drop("n"), "blocks")
    if ahead.limit(SENT_BLOCKS + 1).count() > SENT_BLOCKS:
        ahead = ahead.hint("merge")
    return lines.join(ahead, block).select(
        "crawl_id", "filename", (F.col("ahead") + F.col("place") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line")
    )
