"""Link extraction and the link graph.

``extract_links`` reads each page once and streams its links out row by row,
without a shuffle. Base URL parts are computed per page, not per link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U
from linkloom.functions.columns import let, over
from linkloom.operators.urls import page_scopes, pages_in_scope, strays
from linkloom.session import written


def _tagged(snapshot: DataFrame, *keep: str) -> DataFrame:
    return snapshot.select("url", *keep, over(H.link_tags, "html").alias("tags"))


def extract_hrefs(snapshot: DataFrame) -> DataFrame:
    """``(src, pos, href)``: stripped, non-empty anchor hrefs in page order."""
    # The outer form: for the inner one the optimizer first filters on the size
    # of the array, and so would scan every page twice.
    return (
        _tagged(snapshot)
        .select(
            F.col("url").alias("src"),
            F.posexplode_outer(over(H.anchor_hrefs, "tags")).alias("pos", "href"),
        )
        .filter("href IS NOT NULL")
    )


def page_base_url(snapshot: DataFrame) -> DataFrame:
    """``(src, base)``: the first base href as written, else the page URL."""
    return _tagged(snapshot).select(
        F.col("url").alias("src"),
        F.coalesce(over(H.base_href, "tags"), F.col("url")).alias("base"),
    )


def _href_fault(href: Column) -> Column:
    """Faults that show in the href itself, before any resolution."""
    prefix = F.lower(F.substring_index(href, ":", 1))
    return F.when(href.startswith("#"), F.lit("fragment")).when(
        href.contains(":") & ~prefix.rlike("^(?:https?)?$"), F.lit("non_http_scheme")
    )


def _resolve_all(base: Column, hrefs: Column) -> Column:
    """Each href with its target, in one pass over the array of a page:
    ``array<struct<href, early, dst>>``; ``early`` is a fault of the href."""

    def one(href: Column) -> Column:
        return let(
            _href_fault(href),
            lambda early: F.struct(
                href.alias("href"),
                early.alias("early"),
                F.when(early.isNull(), U.resolve_href(base, href)).alias("dst"),
            ),
        )

    return F.transform(hrefs, one)


def _link_fault(early: Column, dst: Column) -> Column:
    return F.coalesce(
        early,
        F.when(dst.isNull(), F.lit("unresolvable")).when(
            ~U.is_valid_canonical(dst), F.lit("invalid")
        ),
    )


def _targets(base: Column, hrefs: Column) -> Column:
    """The distinct valid targets of the hrefs of a page, in their order."""
    usable = F.filter(F.array_distinct(hrefs), lambda h: _href_fault(h).isNull())
    targets = F.transform(usable, lambda h: U.resolve_href(base, h))
    return F.array_distinct(F.filter(targets, U.is_valid_canonical))


def _page_base(tags: Column, url: Column) -> Column:
    return U.base_parts(F.coalesce(H.base_href(tags), url))


def _based(snapshot: DataFrame, *keep: str) -> DataFrame:
    return _tagged(snapshot, *keep).select(
        "url",
        *keep,
        over(_page_base, "tags", "url").alias("base"),
        over(H.anchor_hrefs, "tags").alias("hrefs"),
    )


def page_links(snapshot: DataFrame) -> DataFrame:
    """``(src, pos, href, fault, dst)`` of every link: its canonical target, and
    as ``fault`` fragment, non_http_scheme, unresolvable, invalid or null.

    Targets are worked out inside the array, so that filters on the result stay
    above the explode and nothing is resolved twice.
    """
    return _unfolded(_link_lists(snapshot), ["src"])


def _link_lists(snapshot: DataFrame) -> DataFrame:
    """``(src, links)``: one compact row per page."""
    return _based(snapshot).select(
        F.col("url").alias("src"), over(_resolve_all, "base", "hrefs").alias("links")
    )


def _unfolded(lists: DataFrame, keep: list[str], *more: str) -> DataFrame:
    """A row per link, with columns of the page to ``keep`` and ``more`` fields of the link."""
    return (
        lists.select(*keep, F.posexplode_outer("links").alias("pos", "link"))
        .filter("link IS NOT NULL")
        .select(
            *keep,
            "pos",
            "link.href",
            _link_fault(F.col("link.early"), F.col("link.dst")).alias("fault"),
            "link.dst",
            *[f"link.{name}" for name in more],
        )
    )


def resolve_links(snapshot: DataFrame) -> DataFrame:
    """``(src, pos, href, dst)`` of every link that resolves to a valid URL."""
    return page_links(snapshot).filter("fault IS NULL").drop("fault")


def _links_per_crawl(snapshot: DataFrame, requests: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
    """Links of each page once per crawl whose scope holds the page; ``lists`` has them by page.

    Bodies are read row-wise where they are stored; what meets the scopes is one
    compact row per page.
    """
    hits = page_scopes(snapshot.select("url"), requests).withColumnRenamed("url", "src")
    return _unfolded(lists.join(hits, "src"), ["crawl_id", "prefix", "src"], *more)


def _with_repeats(links: Column) -> Column:
    """Each link with ``again``: whether its target stands earlier in the array.

    Positions are sorted by target, so that a repeat stands next to the one before it: n log n
    for a page of n links, and the page's row stays where it is.
    """

    def marked(sorted_places: Column) -> Column:
        def one(place: Column, k: Column) -> Column:
            before = F.get(sorted_places, k - F.lit(1))
            same = before["dst"] == place["dst"]
            return F.struct(place["pos"].alias("pos"), F.coalesce(same, F.lit(False)).alias("again"))

        return F.array_sort(F.transform(sorted_places, one))

    places = F.transform(links, lambda link, k: F.struct(link["dst"].alias("dst"), k.alias("pos")))
    flags = let(F.array_sort(places), marked)
    return F.zip_with(links, flags, lambda link, flag: link.withField("again", flag["again"]))


def classify_links(
    snapshot: DataFrame, requests: DataFrame, seen: DataFrame | None = None
) -> DataFrame:
    """``(crawl_id, src, pos, href, dst, reason)``: the first check a link
    fails, or accepted. ``seen(crawl_id, url)`` lists URLs already enqueued.

    Repeats are marked inside the page's array, before its links are rows.
    """
    lists = _link_lists(snapshot).withColumn("links", over(_with_repeats, "links"))
    links = _links_per_crawl(snapshot, requests, lists, "again")
    if seen is not None:
        known = seen.select("crawl_id", F.col("url").alias("dst")).distinct()
        links = links.join(known.withColumn("known", F.lit(True)), ["crawl_id", "dst"], "left")
    else:
        links = links.withColumn("known", F.lit(None).cast("boolean"))
    reason = F.coalesce(
        "fault",
        F.when(~U.in_scope(F.col("dst"), F.col("prefix")), F.lit("out_of_scope"))
        .when(F.col("known"), F.lit("visited"))
        .when(F.col("again"), F.lit("duplicate"))
        .otherwise(F.lit("accepted")),
    )
    return links.withColumn("reason", reason).select("crawl_id", "src", "pos", "href", "dst", "reason")


def classify_counts(classified: DataFrame) -> DataFrame:
    """Number of links per crawl and reason."""
    return classified.groupBy("crawl_id", "reason").agg(F.count(F.lit(1)).alias("n_links"))


def link_graph(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """``(crawl_id, src, pos, dst)``: unique accepted links of every page in
    scope, at their first position. Repeats combine before the shuffle."""
    links = _links_per_crawl(snapshot, requests, _link_lists(snapshot)).filter(
        F.col("fault").isNull() & U.in_scope(F.col("dst"), F.col("prefix"))
    )
    return (
        links.groupBy("crawl_id", "src", "dst")
        .agg(F.min("pos").alias("pos"))
        .select("crawl_id", "src", "pos", "dst")
    )


def drop_visited(links: DataFrame, seen: DataFrame, target: str = "dst") -> DataFrame:
    """Links whose target is not yet in ``seen(crawl_id, url)``."""
    known = seen.select("crawl_id", F.col("url").alias(target))
    return links.join(known, ["crawl_id", target], "left_anti")


def adjacency(snapshot: DataFrame, requests: DataFrame, partitions: int) -> DataFrame:
    """``(url, status, ok, fetched_at, links)`` of each page in scope of some
    crawl; ``links`` are its distinct valid targets in page order.

    One pass over the bodies serves all crawls and all levels. Only the compact
    result is shuffled, into ``partitions`` by URL. Pages outside every scope are dropped before
    they are read for links, as far as ``pages_in_scope`` tells them; one that it leaves is named
    by no link in scope, and if a seed names it, it is dropped here.
    """
    ok = (F.col("status") != -1) & (F.coalesce(F.col("html"), F.lit("")) != "")
    pages = snapshot.withColumn("ok", F.coalesce(ok, F.lit(False)))
    inside = pages_in_scope(pages, requests)
    compact = distinct_targets(inside, "status", "ok", "fetched_at")
    outside = strays(requests)
    if outside is not None:
        # Written first: the optimizer would join the pages with their bodies.
        compact = written(compact, "links").join(outside.hint("merge"), "url", "left_anti")
    return compact.repartition(partitions, "url")


def distinct_targets(pages: DataFrame, *keep: str) -> DataFrame:
    """``url``, columns to ``keep`` and ``links``: the distinct valid targets of each page, in page order."""
    return _based(pages, *keep).select("url", *keep, over(_targets, "base", "hrefs").alias("links"))
