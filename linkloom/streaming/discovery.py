"""Link discovery over a stream of pages.

The state of a canonical URL is the page that counts so far, the one with the smallest id, as the list
of its link targets. Each batch emits the URLs whose state it touched; what was emitted is kept as versions
under a path, and reading them takes the last version of each URL. So the links found
are those of the batch job over all pages that have arrived, in whatever order and however often they came.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.operators.links import distinct_targets
from linkloom.operators.urls import page_scopes
from linkloom.session import new_path
from linkloom.sources.runs import read_or_empty

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
_VERSION_SCHEMA = "src STRING, nameless BOOLEAN, page_id BIGINT, targets ARRAY<STRING>"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Pages from the files of a folder as they arrive, or from a single file.

    A plain path must be a folder for the file source; written as a pattern that
    only matches itself it may be either.
    """
    path = path.rstrip("/")
    pattern = re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
    if path[-1].isalnum():
        pattern = f"{pattern[:-1]}[{path[-1]}]"
    return spark.readStream.schema(PAGES_SCHEMA).parquet(pattern)


def page_versions(pages: DataFrame) -> DataFrame:
    """``(src, page)`` by canonical URL: ``nameless`` (no id), ``page_id`` and link ``targets`` of the
    page with the smallest id, nulls last. As a stream it is state that only ever falls, and never
    expires, just as a crawl never forgets a URL. Bodies are read row-wise and not kept.

    Of pages with one URL and id the smallest list of targets counts.
    """
    keyed = pages.select(over(U.canonical_url, "url").alias("url"), "page_id", "html").filter("url IS NOT NULL")
    lists = distinct_targets(keyed, "page_id")
    page = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", F.col("links").alias("targets"))
    return lists.groupBy(F.col("url").alias("src")).agg(F.min(page).alias("page"))


def write_versions(versions: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Start adding versions under ``path``, a folder per batch; takes what is available.

    A batch that is run again replaces its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.select("src", "page.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = versions.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    # RocksDB keeps the state out of the executors' heap. A query takes the setting when it starts.
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return (
            versions.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint or new_path(spark, "stream-state"))
            .trigger(availableNow=True)
            .foreachBatch(add)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def discovered_links(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """``(crawl_id, url)``: each link in scope once, from the last version of every page under ``path``."""
    versions = read_or_empty(spark.read, _VERSION_SCHEMA, path)
    last = versions.groupBy("src").agg(F.min(F.struct("nameless", "page_id", "targets")).alias("page"))
    last = last.select("src", "page.targets")
    # Scopes meet the page's URL, once per page and not per link.
    hits = page_scopes(versions.select("src").distinct(), requests, "src").withColumnRenamed("url", "src")
    return (
        last.join(hits, "src")
        .select("crawl_id", "prefix", F.explode("targets").alias("url"))
        .filter(U.in_scope(F.col("url"), F.col("prefix")))
        .select("crawl_id", "url")
        .distinct()
    )


def stream_link_discovery(spark: SparkSession, pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Run the discovery over what the stream has now; the links found."""
    path = new_path(spark, "discovered")
    write_versions(page_versions(pages), path).awaitTermination()
    return discovered_links(spark, path, requests)
