"""Bounded breadth-first crawls over a page snapshot, many seeds at once.

Discovery order needs no global sort: a frontier row carries ``ord``, the link
positions followed from the seed, and first-in-first-out order within a level is
the lexicographic order of ``ord``.

A level is looked up in the bucketed page table, narrow columns only; the page cap cuts
it; the links of the pages before the cut are grouped into the next frontier, which meets the
bucketed queue in place and is appended to it. Only the frontier moves, and no level
is read again until the crawl is done. Each step is written to the shared folder, so
a lost executor costs at most the tasks of the running one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.operators.links import adjacency
from linkloom.operators.robots import RuleIndex, robots_checked, robots_rules, rule_index
from linkloom.operators.selection import kth
from linkloom.session import new_path, written
from linkloom.sources.requests import with_defaults

_LEVEL_SCHEMA = (
    "crawl_id BIGINT, url STRING, ord ARRAY<INT>, parent STRING, state STRING, "
    "status_code INT, crawled_at TIMESTAMP, max_depth INT, prefix STRING, respect_robots_txt BOOLEAN"
)
_QUEUED = ["crawl_id", "url", "ord", "parent", "max_depth", "prefix", "respect_robots_txt"]

# The session setting by which a scan of one sorted file per bucket counts as sorted.
_SORTED_FILES = "spark.sql.legacy.bucketedTableScan.outputOrdering"

# Rows of one URL in a level from which its page is copied, so that several tasks look it up.
HOT_ROWS = 50_000


@dataclass
class CrawlRun:
    """Tables of a finished run, backed by files in the shared folder.

    ``requests``  the crawls, with ``prefix`` and ``url`` (canonical seed)
    ``enqueued``  every URL put in a queue: crawl_id, depth, url, ord, parent,
                  state (ok, failed, blocked), status_code, crawled_at and
                  ``over`` (popped only after the page cap was reached)
    """

    requests: DataFrame
    enqueued: DataFrame

    def visited(self) -> DataFrame:
        """Fetched pages in scope of the cap."""
        return self.enqueued.filter("NOT over AND state = 'ok'")

    def page_records(self) -> DataFrame:
        """``(crawl_id, url, depth, status_code, links_found, crawled_at, error)``."""
        found = _unsent(links_found(self))
        return self.visited().join(found, ["crawl_id", "url"], "left").select(
            "crawl_id",
            "url",
            "depth",
            "status_code",
            F.coalesce("links_found", F.lit(0)).cast("int").alias("links_found"),
            "crawled_at",
            F.lit(None).cast("string").alias("error"),
            "ord",
        )

    def failed(self) -> DataFrame:
        """``(crawl_id, url, depth, ord)`` of URLs that gave no page."""
        return self.enqueued.filter("NOT over AND state = 'failed'").select(
            "crawl_id", "url", "depth", "ord"
        )


def links_found(run: CrawlRun) -> DataFrame:
    """``(crawl_id, url, links_found)``: URLs that a page was first to name."""
    return (
        run.enqueued.filter("parent IS NOT NULL")
        .groupBy("crawl_id", F.col("parent").alias("url"))
        .agg(F.count(F.lit(1)).alias("links_found"))
    )


def crawl(
    requests: DataFrame,
    snapshot: DataFrame,
    robots: DataFrame | None = None,
    started_at: datetime | None = None,
) -> CrawlRun:
    """Crawl every request over the snapshot.

    ``requests(crawl_id, seed_url, max_depth, max_pages, respect_robots_txt,
    started_at)`` are valid ones; missing settings get their defaults. Where the
    table has no ``started_at``, the argument gives it for all. ``snapshot`` is keyed
    by canonical URL, ``robots(domain, fetched_at, status, body)`` is optional.
    """
    spark = requests.sparkSession
    if "started_at" not in requests.columns:
        if started_at is None:
            raise ValueError("a crawl needs started_at, as a column or an argument")
        requests = requests.withColumn("started_at", F.lit(started_at).cast("timestamp"))
    requests = written(
        with_defaults(requests)
        .withColumn("url", over(U.canonical_url, "seed_url"))
        .withColumn("prefix", over(U.scope_prefix, "seed_url")),
        "requests",
    )
    rules = None
    if robots is not None:
        rules = rule_index(robots_rules(robots))
    queue = Queue(spark)
    names = [queue.name, _page_table(spark, snapshot, requests)]
    # Each bucket of the pages and of a level is one sorted file, which needs no sorting at every level.
    sorted_files = spark.conf.get(_SORTED_FILES)
    spark.conf.set(_SORTED_FILES, "true")
    try:
        return _levels(spark, requests, spark.table(names[1]), rules, queue, names)
    finally:
        spark.conf.set(_SORTED_FILES, sorted_files)
        # Only the names go; the result reads the levels' files.
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _page_table(spark: SparkSession, snapshot: DataFrame, requests: DataFrame) -> str:
    """Store the pages with their links bucketed by URL: links are shuffled once,
    and every level joins them without moving them again."""
    name = f"linkloom_pages_{uuid.uuid4().hex}"
    _store(adjacency(snapshot, requests, _buckets(spark)), name, new_path(spark, "pages"), ["url"])
    return name


def _store(df: DataFrame, name: str, path: str, keys: list[str]) -> None:
    """Append to the files of a table bucketed and sorted by ``keys``."""
    buckets = _buckets(df.sparkSession)
    writer = df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).mode("append").saveAsTable(name)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Queue:
    """Every URL enqueued so far: a table bucketed by crawl and URL that each level appends to.

    A grouped frontier lies in the same buckets, so it meets the table, and is
    appended to it, without moving either. Files are sorted by crawl and hold one depth each: the
    statistics of their row groups skip other depths and crawls that have ended.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"linkloom_queue_{uuid.uuid4().hex}"
        self.path = new_path(spark, "queue")

    def append(self, frontier: DataFrame, depth: int) -> int:
        """Enqueue a level; its number of rows."""
        counted = Observation()
        rows = frontier.select(*_QUEUED, F.lit(depth).alias("depth")).observe(counted, F.count(F.lit(1)).alias("n"))
        _store(rows, self.name, self.path, ["crawl_id", "url"])
        return counted.get["n"]

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("depth") == depth).drop("depth")

    def unseen(self, frontier: DataFrame, first: int, last: int) -> DataFrame:
        """Rows not enqueued yet; their crawls lie between ``first`` and ``last``."""
        known = self.spark.table(self.name).filter(F.col("crawl_id") >= first)
        if first != last:  # a single id would become a constant, which no bucket has
            known = known.filter(F.col("crawl_id") <= last)
        return frontier.join(_unsent(known.select("crawl_id", "url")), ["crawl_id", "url"], "left_anti")


def _unsent(df: DataFrame) -> DataFrame:
    """For the side of a join that grows with the pages or the crawls. Repetitive URLs and counts take so few
    bytes in their files that the optimizer would pass millions of rows through the driver."""
    return df.hint("merge")


def _levels(
    spark: SparkSession,
    requests: DataFrame,
    pages: DataFrame,
    rules: RuleIndex | None,
    queue: Queue,
    names: list[str],
) -> CrawlRun:
    """Run the levels; the tables made for them are added to ``names``."""
    root = new_path(spark, "crawl")
    limits = ["max_depth", "prefix", "respect_robots_txt"]
    seeds = requests.filter("url IS NOT NULL").select(
        "crawl_id", "url", F.array().cast("array<int>").alias("ord"), F.lit(None).cast("string").alias("parent"), *limits
    )
    caps = requests.select("crawl_id", "max_pages")
    cuts: list[DataFrame] = []
    spent, depth = None, 0
    # One file per bucket, as later levels have.
    n_rows = queue.append(seeds.repartition(_buckets(spark), "crawl_id", "url"), 0)
    while n_rows or not depth:
        frontier = queue.level(depth)
        hot = _hot_urls(frontier) if n_rows > HOT_ROWS else None
        # In the buckets of the pages, which have the links too.
        names.append(f"{queue.name}_{depth}")
        _store(_looked_up(frontier, pages, rules, hot), names[-1], f"{root}/levels/depth={depth}", ["url"])
        level = spark.table(names[-1])
        # The only row per level that reaches the driver.
        facts = Observation()
        tally = written(_tally(level, caps, spent, depth).observe(facts, *_facts()), "tally")
        facts, kept = facts.get, level
        if facts["full"]:
            cut = _cuts(level, tally)
            cuts.append(cut.withColumn("depth", F.lit(depth)))
            kept = level.join(cut, "crawl_id", "left").filter("cut IS NULL OR ord <= last").drop("cut", "last")
        if not facts["n_expands"]:
            break
        # Links are read for pages before the cut only.
        linked = _with_pages(kept.filter(_expands(depth)).select("crawl_id", "url", "ord", *limits), pages, ["links"], hot)
        frontier = queue.unseen(_expand(linked), facts["first"], facts["last"])
        spent = tally.select("crawl_id", (F.col("n_earlier") + F.col("n_ok")).alias("n_earlier"))
        depth += 1
        n_rows = queue.append(frontier, depth)

    rows = spark.read.schema(_LEVEL_SCHEMA + ", depth INT").parquet(f"{root}/levels").drop(*limits)
    if cuts:
        all_cuts = reduce(DataFrame.unionByName, cuts)
        behind = F.col("cut") & F.coalesce(F.col("ord") > F.col("last"), F.lit(True))
        rows = rows.join(all_cuts, ["crawl_id", "depth"], "left").withColumn(
            "over", F.coalesce(behind, F.lit(False))
        ).drop("cut", "last")
    else:
        rows = rows.withColumn("over", F.lit(False))
    return CrawlRun(requests, rows)


# The page cap binds within the level of a crawl.
_FULL = "n_ok >= room"


def _facts() -> list[Column]:
    """What the driver needs to know of a tally: whether and where the crawl goes on, and whether a cap binds."""
    expands = F.col("n_expands") > 0
    return [
        F.sum("n_expands").alias("n_expands"),
        F.max(F.expr(_FULL)).alias("full"),
        F.min(F.when(expands, F.col("crawl_id"))).alias("first"),
        F.max(F.when(expands, F.col("crawl_id"))).alias("last"),
    ]


def _tally(level: DataFrame, caps: DataFrame, spent: DataFrame | None, depth: int) -> DataFrame:
    """Counts of a level per crawl that has rows in it, with the room that
    earlier levels left under the page cap. What they took is carried, not counted again:
    a crawl with rows in a level has some in every earlier one."""
    ok = F.col("state") == "ok"
    counts = level.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(_expands(depth)).alias("n_expands"),
    ).join(_unsent(caps), "crawl_id")
    if spent is None:
        counts = counts.withColumn("n_earlier", F.lit(0).cast("bigint"))
    else:
        counts = counts.join(_unsent(spent), "crawl_id")
    return counts.withColumn("room", F.greatest(F.col("max_pages") - F.col("n_earlier"), F.lit(0)))


def _expands(depth: int) -> Column:
    return (F.col("state") == "ok") & (F.col("max_depth") > depth)


def _hot_urls(frontier: DataFrame) -> DataFrame | None:
    """``(url, copies)`` of the URLs that so many crawls name in a level that one task
    should not look them up; at most one URL per ``HOT_ROWS`` rows."""
    counts = frontier.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS)
    hot = written(counts.select("url", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("copies")), "hot")
    return None if hot.isEmpty() else hot


def _with_pages(rows: DataFrame, pages: DataFrame, columns: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` with columns of their stored pages, null where there is none.

    The rows are moved to the buckets of the pages, where they are not there yet. Those of hot URLs are spread by crawl
    instead, and their few pages are copied to every place they may come to.
    """
    found = _unsent(pages.select("url", *columns))
    if hot is None:
        return rows.join(found, "url", "left")
    names = [*rows.columns, *columns]
    cold = rows.join(hot, "url", "left_anti").join(found, "url", "left").select(*names)
    copies = pages.select("url", *columns).join(hot, "url").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    spread = rows.join(hot, "url").withColumn("_copy", F.pmod(F.xxhash64("crawl_id"), F.col("copies")).cast("int"))
    return cold.union(spread.join(copies.drop("copies"), ["url", "_copy"], "left").select(*names))


def _looked_up(
    frontier: DataFrame, pages: DataFrame, rules: RuleIndex | None, hot: DataFrame | None = None
) -> DataFrame:
    """The state of each frontier row: robots first, then the page table, whose links stay unread."""
    if rules is None:
        checked = frontier.withColumn("allowed", F.lit(True))
    else:
        # All URLs of a crawl are on the domain of its seed.
        checked = robots_checked(frontier.withColumn("_domain", F.substring_index("prefix", "/", 1)), rules)
        checked = checked.withColumn("allowed", ~F.col("respect_robots_txt") | F.col("allowed")).drop("_domain")
    state = (
        F.when(~F.col("allowed"), F.lit("blocked"))
        .when(F.col("ok"), F.lit("ok"))
        .otherwise(F.lit("failed"))
    )
    return _with_pages(checked, pages, ["status", "ok", "fetched_at"], hot).select(
        "crawl_id",
        "url",
        "ord",
        "parent",
        state.alias("state"),
        F.when(F.col("allowed"), F.col("status")).alias("status_code"),
        F.when(F.col("allowed"), F.col("fetched_at")).alias("crawled_at"),
        "max_depth",
        "prefix",
        "respect_robots_txt",
    )


def _cuts(level: DataFrame, tally: DataFrame) -> DataFrame:
    """``(crawl_id, last, cut)``: for crawls whose cap binds in this level, the ``ord`` of the page
    that fills it, or null where earlier levels left no room and nothing counts."""
    full = tally.filter(_FULL)
    pages = level.filter("state = 'ok'").select("crawl_id", F.col("ord").alias("last"))
    filled = kth(pages, "crawl_id", "last", full.filter("room > 0").select("crawl_id", F.col("room").alias("k")))
    none = full.filter("room = 0").select("crawl_id", F.lit(None).cast("array<int>").alias("last"))
    return written(filled.unionByName(none).withColumn("cut", F.lit(True)), "cuts")


def _inside(links: Column, prefix: Column) -> Column:
    return F.filter(links, lambda x: U.in_scope(x, prefix))


def _expand(pages: DataFrame) -> DataFrame:
    """Children in scope, one row per crawl and URL with its first parent."""
    children = pages.select(
        "crawl_id", "url", "ord", "max_depth", "prefix", "respect_robots_txt",
        F.posexplode(over(_inside, "links", "prefix")).alias("pos", "dst"),
    )
    first = F.min(F.struct(F.array_append("ord", F.col("pos")).alias("ord"), F.col("url").alias("parent")))
    # The settings are the same in all rows of a crawl.
    settings = [F.first(c).alias(c) for c in ("max_depth", "prefix", "respect_robots_txt")]
    found = children.groupBy("crawl_id", F.col("dst").alias("url")).agg(first.alias("first"), *settings)
    return found.select("crawl_id", "url", "first.*", "max_depth", "prefix", "respect_robots_txt")
