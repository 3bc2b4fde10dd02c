"""Jobs over URL columns: filters, canonical duplicates, rollups and scope."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.session import written

# Most scopes that pages are tested against one by one, and most domains sent to every task.
TESTED_SCOPES = 32
SENT_DOMAINS = 20_000


def scheme_filter(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL has a crawlable scheme."""
    return df.filter(over(U.has_crawlable_scheme, url))


def valid_url_filter(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is http(s) with a well-formed authority."""
    return df.filter(over(U.is_valid_url, url))


def canonicalize_urls(df: DataFrame, url: str = "url", out: str = "url_norm") -> DataFrame:
    """Add the canonical form of a URL column."""
    return df.withColumn(out, over(U.canonical_url, url))


def canonical_duplicates(df: DataFrame, url: str = "url") -> DataFrame:
    """Canonical forms that more than one row shares, with size and spellings.

    Both steps combine before they shuffle, so a form shared by very many rows
    costs one record per task.
    """
    spellings = (
        canonicalize_urls(df.select(url), url)
        .groupBy("url_norm", F.col(url).alias("spelling"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        spellings.filter(F.col("url_norm").isNotNull())
        .groupBy("url_norm")
        .agg(
            F.sum("n").alias("n_urls"),
            F.count(F.lit(1)).alias("n_spellings"),
            F.min("spelling").alias("first_spelling"),
        )
        .filter("n_urls > 1")
    )


def domain_rollup(df: DataFrame, url: str = "url") -> DataFrame:
    """Pages per domain."""
    return df.groupBy(over(U.url_domain, url).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_pages")
    )


def seed_scope(requests: DataFrame) -> DataFrame:
    """Add ``domain`` and ``scope_path`` of each crawl request."""
    return requests.withColumn("domain", over(U.url_domain, "seed_url")).withColumn(
        "scope_path", over(U.scope_path, "seed_url")
    )


def scope_join(urls: DataFrame, requests: DataFrame, url: str = "url") -> DataFrame:
    """``(crawl_id, url)`` for each canonical URL inside the scope of a crawl.

    An equi-join: a URL is keyed by its path and that path's ancestors, a scope by
    its own path, so only true matches meet, however many pages and crawls a
    domain has. No side is forced to broadcast: the optimizer does it below its
    size threshold, and above it a frequent key is split by the adaptive skew join.
    """
    return page_scopes(urls, requests, url).select("crawl_id", "url")


def page_scopes(urls: DataFrame, requests: DataFrame, url: str = "url") -> DataFrame:
    """``(crawl_id, prefix, url)`` for each canonical URL and scope that holds it."""
    return _keyed(urls, url).join(scope_table(requests), "key").select("crawl_id", "prefix", "url")


def pages_in_scope(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows of ``pages`` that can be in the scope of some crawl, chosen where they are: no
    body moves, and nothing that grows with the crawls is sent to every task.

    Up to ``TESTED_SCOPES`` distinct scopes are tested one by one. Of more only the domains
    count, and where they too are many, every page stays.
    """
    prefixes = requests.select(over(U.scope_prefix, "seed_url").alias("prefix")).distinct().filter("prefix IS NOT NULL")
    few = [r.prefix for r in prefixes.limit(TESTED_SCOPES + 1).collect()]
    if len(few) <= TESTED_SCOPES:
        return pages.filter(reduce(or_, [U.in_scope(F.col("url"), F.lit(p)) for p in few], F.lit(False)))
    domains = written(requests.select(over(U.url_domain, "seed_url").alias("_domain")).distinct(), "domains")
    if domains.limit(SENT_DOMAINS + 1).count() > SENT_DOMAINS:
        return pages
    return pages.join(F.broadcast(domains), U.url_domain(F.col("url")) == F.col("_domain"), "left_semi")


def strays(requests: DataFrame) -> DataFrame | None:
    """``url`` of the seeds that are in no crawl's scope, not even their own (as one that ends with a
    blank); None if each is in its own."""
    seeds = requests.select(over(U.canonical_url, "seed_url").alias("url"), over(U.scope_prefix, "seed_url").alias("prefix"))
    odd = seeds.filter(F.col("url").isNotNull() & ~F.coalesce(over(U.in_scope, "url", "prefix"), F.lit(False)))
    odd = written(odd.select("url").distinct(), "odd-seeds")
    if odd.isEmpty():
        return None
    keys = scope_table(requests).select("key").distinct()
    hits = _keyed(odd, "url").join(keys.hint("merge"), "key", "left_semi").select("url")
    return written(odd.join(hits, "url", "left_anti"), "strays")


def scope_table(requests: DataFrame) -> DataFrame:
    """``(crawl_id, prefix, key)`` of each crawl's scope."""
    scopes = requests.select("crawl_id", over(U.scope_prefix, "seed_url").alias("prefix"))
    return scopes.select("crawl_id", "prefix", F.explode(U.keys_of_scope(F.col("prefix"))).alias("key"))


def _keyed(urls: DataFrame, url: str) -> DataFrame:
    keyed = urls.select(F.col(url).alias("url"))
    return keyed.select("url", F.explode(U.scope_keys(F.col("url"))).alias("key"))
