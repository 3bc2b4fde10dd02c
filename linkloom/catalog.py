"""The named queries: every operator as a job over the given tables.

Arrays are joined to text and counts are big integers, so that results compare
directly with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import fetchlog, links, politeness, robots
from linkloom.operators import urls as url_jobs
from linkloom.plans import report
from linkloom.plans.crawl import CrawlRun, crawl, links_found
from linkloom.session import new_path, spread
from linkloom.sources import derived as D
from linkloom.sources import crawl_store
from linkloom.sources import runs as store
from linkloom.sources.requests import validate_requests
from linkloom.sources.rows import identified
from linkloom.sources.snapshot import page_snapshot, snapshot_from_outcomes
from linkloom.streaming.discovery import page_stream, stream_link_discovery

# When the crawls of the stored pages are taken to start.
STARTED = datetime(2026, 1, 1, tzinfo=timezone.utc)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, without a trailing ``_query``."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def _pages(spark, sf):
    return D.table(spark, sf, "pages")


def _snapshot(spark, sf):
    return page_snapshot(spread(identified(_pages(spark, sf))))


def _noisy(spark, sf):
    return page_snapshot(D.noisy_pages(spread(identified(_pages(spark, sf)))))


# -- crawls that several queries look at -----------------------------------------


def crawl_shop(spark: SparkSession, sf: str) -> CrawlRun:
    return crawl(D.shop_requests(spark, sf), D.shop_web(spark, sf), D.shop_robots(spark, sf))


def crawl_hosts(spark: SparkSession, sf: str) -> CrawlRun:
    pages = _pages(spark, sf)
    return crawl(D.host_requests(pages), D.host_web(pages), D.host_robots(pages), STARTED)


def _shop(spark, sf):
    return crawl_shop(spark, sf)


def _hosts(spark, sf):
    return crawl_hosts(spark, sf)


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# -- sources and sinks ----------------------------------------------------------


@query
def page_snapshot_query(spark, sf):
    return _snapshot(spark, sf).select(
        "url", F.col("status").cast("bigint").alias("status"), F.md5("html").alias("html_md5")
    )


@query
def validate_requests_query(spark, sf):
    checked = validate_requests(D.raw_requests(spark, sf))
    return _ints(
        checked.select("crawl_id", "seed_url", "max_depth", "max_pages", "error"),
        "max_depth",
        "max_pages",
    )


def _store_path(spark):
    return new_path(spark, "runs")


def _document_columns(df):
    return df.select(
        "crawl_id",
        "seed_url",
        "status",
        F.col("total_pages").cast("bigint").alias("total_pages"),
        F.array_join("urls_visited", " ").alias("urls_visited"),
        F.size("pages").cast("bigint").alias("n_pages"),
        F.unix_micros("started_at").alias("started_micros"),
        F.round("duration_seconds", 3).alias("duration_seconds"),
    )


@query
def save_runs(spark, sf):
    path = _store_path(spark)
    store.save_runs(D.crawl_runs(spark, sf), path)
    return _document_columns(store.read_runs(spark, path))


@query
def save_runs_json(spark, sf):
    path = _store_path(spark)
    store.save_runs(D.crawl_runs(spark, sf), path, "json")
    return _document_columns(store.read_runs(spark, path, "json"))


@query
def save_many(spark, sf):
    return store.save_many(D.crawl_runs(spark, sf), _store_path(spark))


def _saved(spark, sf):
    path = _store_path(spark)
    store.save_runs(D.crawl_runs(spark, sf), path)
    return path


def _seeds(spark, sf):
    """Seeds of the even customers, stored or not."""
    c = F.col("c_custkey")
    name = c.cast("string")
    return (
        D.table(spark, sf, "customer")
        .filter(c % 2 == 0)
        .select(
            F.when(c % 3 == 0, D.text("https://shop.example.com/c/", name, "/?q=é&r=1"))
            .otherwise(D.text("http://shop.example.com/c//", name))
            .alias("seed_url")
        )
    )


@query
def load_latest(spark, sf):
    return _document_columns(store.load_latest(spark, _saved(spark, sf)))


@query
def load_latest_of_seeds(spark, sf):
    return _document_columns(store.load_latest(spark, _saved(spark, sf), _seeds(spark, sf)))


@query
def run_exists(spark, sf):
    return store.run_exists(spark, _saved(spark, sf), _seeds(spark, sf))


@query
def delete_latest(spark, sf):
    path = _saved(spark, sf)
    return store.delete_latest(spark, path, _seeds(spark, sf))


@query
def runs_after_delete(spark, sf):
    path = _saved(spark, sf)
    store.delete_latest(spark, path, _seeds(spark, sf))
    return store.read_runs(spark, path).select("crawl_id", "seed_url")


@query
def list_crawls(spark, sf):
    return _ints(store.list_crawls(spark, _saved(spark, sf)), "total_pages")


@query
def run_filename(spark, sf):
    return D.crawl_runs(spark, sf).select(
        "crawl_id", store.run_filename(F.col("seed_url"), F.col("started_at")).alias("filename")
    )


# -- URLs -----------------------------------------------------------------------


def _hrefs(spark, sf):
    return links.extract_hrefs(_noisy(spark, sf))


@query
def scheme_filter(spark, sf):
    kept = url_jobs.scheme_filter(_hrefs(spark, sf), "href")
    return kept.groupBy("href").agg(F.count(F.lit(1)).alias("n_links"))


@query
def valid_url_filter(spark, sf):
    kept = url_jobs.valid_url_filter(_hrefs(spark, sf), "href")
    return kept.groupBy("href").agg(F.count(F.lit(1)).alias("n_links"))


@query
def canonicalize_urls(spark, sf):
    return url_jobs.canonicalize_urls(_pages(spark, sf)).select("page_id", "url", "url_norm")


@query
def canonical_duplicates(spark, sf):
    twins = _pages(spark, sf).select(
        F.explode(
            F.array(
                F.col("url"),
                D.text(F.substring_index("url", "#", 1), "#again"),
                D.text(F.substring_index(F.substring_index("url", "#", 1), "?", 1), "?z=1&a=2"),
                D.text(F.substring_index(F.substring_index("url", "#", 1), "?", 1), "?a=2&b=&z=1"),
            )
        ).alias("url")
    )
    return url_jobs.canonical_duplicates(twins)


@query
def domain_rollup(spark, sf):
    return url_jobs.domain_rollup(_pages(spark, sf))


@query
def resolve_links(spark, sf):
    return links.resolve_links(_noisy(spark, sf)).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_links")
    )


@query
def seed_scope(spark, sf):
    return url_jobs.seed_scope(D.narrow_requests(_pages(spark, sf))).select(
        "crawl_id", "seed_url", "domain", "scope_path"
    )


@query
def scope_join(spark, sf):
    pages = _pages(spark, sf)
    return url_jobs.scope_join(_snapshot(spark, sf), D.narrow_requests(pages))


# -- links ----------------------------------------------------------------------


@query
def extract_hrefs(spark, sf):
    return _ints(links.extract_hrefs(_snapshot(spark, sf)), "pos")


@query
def extract_hrefs_noisy(spark, sf):
    return _ints(_hrefs(spark, sf), "pos")


@query
def page_base_url(spark, sf):
    return links.page_base_url(_noisy(spark, sf))


def _classified(spark, sf):
    pages = _pages(spark, sf)
    requests = D.narrow_requests(pages)
    seen = requests.select(
        "crawl_id",
        D.text("http://", U.url_domain(F.col("seed_url")), "/Mixed").alias("url"),
    )
    return links.classify_links(_noisy(spark, sf), requests, seen)


@query
def classify_links(spark, sf):
    return _ints(_classified(spark, sf).drop("dst"), "pos")


@query
def classify_counts(spark, sf):
    return links.classify_counts(_classified(spark, sf))


@query
def link_graph(spark, sf):
    pages = _pages(spark, sf)
    return _ints(links.link_graph(_snapshot(spark, sf), D.host_requests(pages)), "pos")


@query
def link_graph_by_domain(spark, sf):
    pages = _pages(spark, sf)
    edges = links.link_graph(_snapshot(spark, sf), D.host_requests(pages))
    return edges.groupBy(U.url_domain(F.col("src")).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_edges")
    )


@query
def drop_visited(spark, sf):
    pages = _pages(spark, sf)
    edges = links.link_graph(_snapshot(spark, sf), D.host_requests(pages))
    # Every other page was crawled before: its links are known.
    seen = (
        edges.join(_pages(spark, sf).filter("page_id % 2 = 0").select(U.canonical_url(F.col("url")).alias("src")), "src")
        .select("crawl_id", F.col("dst").alias("url"))
        .distinct()
    )
    return links.drop_visited(edges, seen).select("crawl_id", "src", "dst")


# -- robots and politeness ------------------------------------------------------


def _rules(spark, sf):
    return robots.robots_rules(D.host_robots(_pages(spark, sf)))


@query
def robots_rules(spark, sf):
    line = F.transform(
        "rules", lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["path"])
    )
    return _rules(spark, sf).select(
        "domain", F.array_join("agents", ",").alias("agents"), "delay", F.array_join(line, "|").alias("rules")
    )


@query
def robots_allowed(spark, sf):
    urls = _snapshot(spark, sf).select("url")
    return robots.robots_allowed(urls, _rules(spark, sf))


@query
def robots_allowed_named_agent(spark, sf):
    rules = robots.robots_rules(D.host_robots(_pages(spark, sf)), "OtherBot/2.0")
    return robots.robots_allowed(_snapshot(spark, sf).select("url"), rules)


@query
def crawl_delay(spark, sf):
    domains = url_jobs.domain_rollup(_pages(spark, sf)).select("domain")
    return robots.crawl_delay(domains, _rules(spark, sf))


@query
def domain_delays(spark, sf):
    requests = D.host_requests(_pages(spark, sf)).withColumn("politeness_delay", F.lit(1.5))
    return robots.domain_delays(requests, _rules(spark, sf))


@query
def robots_fetch_plan(spark, sf):
    return politeness.robots_fetch_plan(D.request_log(spark, sf)).select("domain", "seq", "fetches")


@query
def robots_fetch_plan_spread(spark, sf):
    """The same by the way meant for very large domains."""
    plan = politeness.robots_fetch_plan(D.request_log(spark, sf), window_rows=0)
    return plan.select("domain", "seq", "fetches")


def _schedule(df):
    return df.select(
        "domain",
        "seq",
        F.unix_micros("start_at").alias("start_micros"),
        F.round("wait_seconds", 6).alias("wait_seconds"),
    )


@query
def politeness_schedule(spark, sf):
    return _schedule(
        politeness.politeness_schedule(D.request_log(spark, sf), D.log_delays(spark, sf))
    )


@query
def politeness_schedule_spread(spark, sf):
    """The same by the way meant for very large domains."""
    return _schedule(
        politeness.politeness_schedule(
            D.request_log(spark, sf), D.log_delays(spark, sf), window_rows=0
        )
    )


# -- fetch log ------------------------------------------------------------------


@query
def fetch_outcome(spark, sf):
    return _ints(fetchlog.fetch_outcome(D.fetch_attempts(spark, sf)), "status")


@query
def retry_budget(spark, sf):
    return fetchlog.retry_budget(D.fetch_attempts(spark, sf))


@query
def split_outcomes(spark, sf):
    won = fetchlog.winning_attempts(D.fetch_attempts(spark, sf))
    return fetchlog.split_outcomes(won).select("url", "outcome")


# -- crawls ---------------------------------------------------------------------


def _records(run: CrawlRun):
    return _ints(
        run.page_records().select("crawl_id", "url", "depth", "status_code", "links_found"),
        "depth",
        "status_code",
        "links_found",
    )


@query
def crawl_query(spark, sf):
    return _records(_shop(spark, sf))


@query
def crawl_failed(spark, sf):
    return _ints(_shop(spark, sf).failed().drop("ord"), "depth")


@query
def crawl_hosts_query(spark, sf):
    return _records(_hosts(spark, sf))


@query
def crawl_hosts_failed(spark, sf):
    return _ints(_hosts(spark, sf).failed().drop("ord"), "depth")


@query
def depth_limit(spark, sf):
    """Pages per depth; none lies below the limit of its crawl."""
    run = _shop(spark, sf)
    return _ints(
        run.visited()
        .join(run.requests.select("crawl_id", "max_depth"), "crawl_id")
        .groupBy("crawl_id", "max_depth", "depth")
        .agg(F.count(F.lit(1)).alias("n_pages")),
        "max_depth",
        "depth",
    )


@query
def page_cap(spark, sf):
    """The first pages of each host in page order, under the cap of its crawl."""
    pages = _pages(spark, sf)
    requests = D.host_requests(pages)
    keyed = url_jobs.scope_join(_snapshot(spark, sf), requests)
    return report.page_cap(keyed, requests, ["url"]).select("crawl_id", "url")


@query
def links_found_query(spark, sf):
    return links_found(_shop(spark, sf))


@query
def crawl_status(spark, sf):
    return report.crawl_status(_shop(spark, sf)).unionByName(
        report.crawl_status(_hosts(spark, sf)).withColumn("crawl_id", F.col("crawl_id") + 1000)
    )


@query
def crawl_stats(spark, sf):
    stats = report.crawl_stats(_shop(spark, sf))
    return _ints(
        stats.select(
            "crawl_id",
            "seed_url",
            "status",
            "total_pages",
            "failed_urls",
            "max_depth_reached",
            F.unix_micros("finished_at").alias("finished_micros"),
            F.round("duration_seconds", 3).alias("duration_seconds"),
        ),
        "max_depth_reached",
    )


@query
def crawl_result_document(spark, sf):
    """Documents of the host crawls with their lists as text."""
    docs = report.crawl_result_document(_hosts(spark, sf))
    page = F.transform(
        "pages",
        lambda p: F.concat_ws(" ", p["url"], p["depth"], p["status_code"], p["links_found"]),
    )
    return docs.select(
        "crawl_id",
        "seed_url",
        "status",
        F.coalesce("error", F.lit("")).alias("error"),
        F.col("max_depth_reached").cast("bigint").alias("max_depth_reached"),
        F.col("total_pages").cast("bigint").alias("total_pages"),
        F.array_join("urls_visited", "\n").alias("urls_visited"),
        F.array_join("urls_failed", "\n").alias("urls_failed"),
        F.array_join(page, "\n").alias("pages"),
    )


@query
def crawl_documents(spark, sf):
    """Lines of the JSON documents of the shop crawls, written as text and read again."""
    path = new_path(spark, "documents")
    crawl_store.write_documents(_shop(spark, sf), path)
    return crawl_store.read_documents(spark, path)


@query
def crawl_summary(spark, sf):
    return report.crawl_summary(_shop(spark, sf))


@query
def crawl_report(spark, sf):
    listing = report.crawl_report(_shop(spark, sf))
    return _ints(listing, "position", "more_visited")


def _saved_hosts(spark, sf):
    path = _store_path(spark)
    crawl_store.save_crawl(_hosts(spark, sf), path)
    return path


@query
def crawl_store_pages(spark, sf):
    """Page rows of the host crawls, saved and loaded again."""
    pages = crawl_store.latest_pages(spark, _saved_hosts(spark, sf))
    return _ints(pages.select("seed_url", "url", "depth", "status_code", "links_found"), "depth", "status_code", "links_found")


@query
def crawl_store_list(spark, sf):
    """The listing of the saved host crawls after the successful ones were deleted."""
    path = _saved_hosts(spark, sf)
    done = store.list_crawls(spark, path).filter("status = 'success'").select("seed_url")
    store.delete_latest(spark, path, done)
    return _ints(store.list_crawls(spark, path).select("seed_url", "status", "total_pages"), "total_pages")


def _stored_pages(spark, sf):
    """Pages stored with bodies for client and server errors too."""
    status = F.when(F.col("page_id") % 7 == 3, 404).when(F.col("page_id") % 7 == 5, 503).otherwise(200)
    return _pages(spark, sf).withColumn("status", status)


@query
def page_snapshot_errors(spark, sf):
    """The snapshot of pages among which are errors with bodies."""
    snapshot = page_snapshot(_stored_pages(spark, sf))
    return snapshot.select("url", F.col("status").cast("bigint").alias("status"), F.md5("html").alias("html_md5"))


@query
def crawl_errors(spark, sf):
    """Every stored page as the seed of a crawl of depth 0: visited or failed."""
    pages = _stored_pages(spark, sf)
    requests = pages.select(F.col("page_id").alias("crawl_id"), F.col("url").alias("seed_url"), F.lit(0).alias("max_depth"))
    return _outcomes(crawl(requests, page_snapshot(pages), None, STARTED))


@query
def crawl_attempts(spark, sf):
    """Crawls of depth 0 over what the retried fetches of the order pages gave."""
    outcomes = fetchlog.fetch_outcome(D.fetch_attempts(spark, sf))
    requests = outcomes.select(
        F.regexp_extract("url", r"(\d+)(?:\.html)?$", 1).cast("bigint").alias("crawl_id"),
        F.col("url").alias("seed_url"),
        F.lit(0).alias("max_depth"),
    )
    found = _outcomes(crawl(requests, snapshot_from_outcomes(outcomes), None, STARTED))
    # A seed that is no URL is never enqueued. Crawls are as many as orders: neither side is for the driver.
    return requests.select("crawl_id").join(found.hint("merge"), "crawl_id", "left").select(
        "crawl_id", F.coalesce("state", F.lit("failed")).alias("state"), F.coalesce("status_code", F.lit(-1)).alias("status_code")
    )


def _outcomes(run: CrawlRun):
    found = run.enqueued.select("crawl_id", "state", F.col("status_code").cast("bigint").alias("status_code"))
    return found


# -- streaming ------------------------------------------------------------------


@query
def stream_link_discovery_query(spark, sf):
    requests = D.host_requests(_pages(spark, sf))
    return stream_link_discovery(spark, page_stream(spark, f"{sf}/pages.parquet"), requests)
