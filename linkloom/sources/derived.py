"""Webs, logs and stores derived from the given tables.

Each row of a table becomes its own page, request or attempt by arithmetic on
its key, so the derived data grow with the tables and no page has to gather an
unbounded group of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.operators.running import running
from linkloom.sources.rows import ROW, identified
from linkloom.sources.snapshot import page_snapshot

SHOP = "http://shop.example.com"
FANOUT = 8
ROOT_CUSTOMERS = 25 * FANOUT
NO_CAP = 2_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _anchors(hrefs: Column) -> Column:
    return F.array_join(
        F.transform(hrefs, lambda h: F.concat(F.lit('<a href="'), h, F.lit('">x</a>'))), ""
    )


# -- pages and the web of their hosts -------------------------------------------


def host_requests(pages: DataFrame) -> DataFrame:
    """One crawl per host from its root, with limits that vary by host."""
    hosts = pages.groupBy(over(U.url_domain, "url").alias("host")).agg(
        F.min("page_id").alias("crawl_id")
    )
    return hosts.select(
        "crawl_id",
        text("http://", F.col("host"), "/").alias("seed_url"),
        (F.col("crawl_id") % 5).cast("int").alias("max_depth"),
        F.when(F.col("crawl_id") % 3 == 0, F.lit(5)).otherwise(F.lit(NO_CAP)).alias("max_pages"),
        (F.col("crawl_id") % 7 != 0).alias("respect_robots_txt"),
    )


def narrow_requests(pages: DataFrame) -> DataFrame:
    """The host crawls and, per host, a second one below ``/en``."""
    wide = host_requests(pages)
    narrow = wide.withColumns(
        {
            "crawl_id": F.col("crawl_id") + 1_000_000_000,
            "seed_url": F.replace(
                F.concat("seed_url", F.lit("en")), F.lit("http://"), F.lit("https://")
            ),
        }
    )
    return wide.unionByName(narrow)


def noisy_pages(pages: DataFrame) -> DataFrame:
    """Pages with awkward links added: every fifth one also has a base tag."""
    host = over(U.url_domain, "url")
    scheme = F.substring_index("url", ":", 1)
    base = F.when(
        F.col("page_id") % 5 == 0,
        text('<base href="', scheme, "://", host, '/based/dir/page.html">'),
    ).otherwise(F.lit(""))
    noise = text(
        '<a href="#frag">f</a><a href="mailto:x@example.org">m</a><a href=\'tel:1\'>t</a>'
        '<a href=javascript:void(0)>j</a><a href="/wiki/Help:X">w</a><a href="//[bad/">b</a>'
        '<a href="https:///nohost">n</a><A HREF="/dup">1</A><a class="a>b" href="/dup#again">2</a>'
        '<a href=" /dup ">3</a><a href="/q?b=2&amp;a=1&amp;c=">q</a><a href="../up?x=1">u</a>'
        '<a href="sub/./leaf">s</a><a href="HTTP://',
        F.upper(host),
        '/Mixed">x</a><a href="https://other.example.org/x">o</a><a name="n">no</a><a href="">e</a>'
        "<!-- <a href=\"/hidden\"> --><script>var a = \"<a href='/js'>\";</script>"
        "<img alt=\"<a href='/alt'>\"><abbr href='/abbr'>",
    )
    return pages.withColumn("html", F.concat(base, F.col("html"), noise))


def host_web(pages: DataFrame) -> DataFrame:
    """Snapshot in which the pages of a host form a tree.

    The n-th page of a host, by ``page_id``, gets links to pages 8n+1 to 8n+8;
    the host's root page links its first one. The numbering is a running count
    that spreads over many tasks for a host with very many pages.
    """
    pages = identified(pages)
    keyed = pages.withColumn("host", over(U.url_domain, "url"))
    ranked = running(
        keyed.select("host", "page_id", "url", ROW),
        ["host"],
        ["page_id"],
        {"rank": ("sum", F.lit(1))},
        before=True,
    )
    href = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    children = (
        ranked.filter("rank > 0")
        .groupBy("host", F.floor((F.col("rank") - 1) / FANOUT).alias("rank"))
        .agg(F.sort_array(F.collect_list(F.struct("page_id", href.alias("href")))).alias("c"))
        .select("host", "rank", _anchors(F.col("c.href")).alias("nav"))
    )
    navs = ranked.join(children, ["host", "rank"], "left").select("page_id", "nav")
    linked = pages.join(navs, "page_id").select(
        "page_id", "url", F.concat("html", F.coalesce("nav", F.lit(""))).alias("html"), ROW
    )
    roots = ranked.filter("rank = 0").select(
        (-F.col("page_id") - 1).alias("page_id"),
        text("http://", F.col("host"), "/").alias("url"),
        _anchors(F.array(href)).alias("html"),
        F.struct(text(F.col("_row_id.file"), "#root").alias("file"), F.col("_row_id.index").alias("index")).alias(ROW),
    )
    return page_snapshot(linked.unionByName(roots)).withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1_767_225_600) + F.length("html"))
    )


def host_robots(pages: DataFrame) -> DataFrame:
    """robots.txt of each host: missing, two kinds of bodies, or a server error."""
    hosts = pages.groupBy(over(U.url_domain, "url").alias("domain")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    kind = F.col("first") % 4
    mixed = text(
        "# rules of ",
        F.col("domain"),
        "\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /en/1\nAllow: /en/\n"
        "Disallow: /de/%31\nDisallow: /fr/ # all of it\nUnknown: x\nCrawl-delay: ",
        (F.col("n") % 5).cast("string"),
        "\n\nUser-agent: *\nDisallow: /\n",
    )
    open_after = F.lit(
        "user-AGENT: *\r\nAllow: /es/5\r\nDisallow: /es/\r\ncrawl-delay: soon\r\n"
        "Disallow:\r\nDisallow: /en/\r\n"
    )
    return hosts.select(
        "domain",
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
        F.when(kind == 0, F.lit(404)).when(kind == 3, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(kind == 1, mixed)
        .when(kind == 2, open_after)
        .otherwise(F.lit("User-agent: *\nDisallow: /\n"))
        .alias("body"),
    )


# -- the shop web ---------------------------------------------------------------


def shop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the shop per region, each with other limits."""
    # Depth, page cap and robots flag by region key.
    limits = [(4, NO_CAP, True), (3, 100, True), (60, NO_CAP, False), (6, 500, False), (0, 10, True)]
    key = F.col("r_regionkey") % len(limits)

    def by_key(values):
        choice = F.lit(values[0])
        for i, v in enumerate(values[1:], 1):
            choice = F.when(key == i, F.lit(v)).otherwise(choice)
        return choice

    depth, cap, respect = zip(*limits)
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("crawl_id"),
        F.lit(f"{SHOP}/3/").alias("seed_url"),
        by_key(depth).alias("max_depth"),
        by_key(cap).alias("max_pages"),
        by_key(respect).alias("respect_robots_txt"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("started_at"),
    )


def shop_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot with a page per region, nation, customer and order.

    Regions lead to nations, nations to the first customers, customer ``c`` to
    customers ``8c+200 ...`` and orders ``10c ...``, an order to the customer
    that placed it. Some targets do not exist. Customers in debt answer 404.
    """

    def numbered(kind: str, first: Column, step: int, n: int, end: str = "/") -> Column:
        return F.array(*[text(f"/3/{kind}/", (first + k * step).cast("string"), end) for k in range(n)])

    def page(path: Column, hrefs: Column, parent: Column, status: Column, second: Column) -> list:
        first = F.get(hrefs, F.lit(0))
        noise = text(
            '<a href="', first, '">again</a><A HREF="HTTP://SHOP.EXAMPLE.COM', first, '">upper</A>'
            "<a href='#frag'>f</a><a href='mailto:a@b.c'>m</a><a href='tel:1'>t</a>"
            "<a href='javascript:void(0)'>j</a><a href='/2/out/'>o</a>"
            "<a href='http://elsewhere.example.org/3/'>e</a><a href='/3/wiki/Help:X'>h</a>",
            '<a href="', parent, '">up</a>',
        )
        # The hrefs of a page are null all together, and then so is the noise.
        anchors = text('<a href="', F.array_join(hrefs, '">x</a><a href="'), '">x</a>')
        html = F.when(status == 200, text("<html><body>", anchors, noise, "</body></html>"))
        return [
            text(SHOP, path).alias("url"),
            status.alias("status"),
            F.coalesce(html, F.lit("")).alias("html"),
            F.timestamp_seconds(F.lit(1_767_225_600) + second).alias("fetched_at"),
        ]

    found = F.lit(200)
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    # Pages are much larger than the rows they come from: spread the keys first.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    customer = customer.repartition(width, "c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.repartition(width, "o_orderkey")
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    root = region.filter("r_regionkey = 0").select(
        *page(F.lit("/3/"), numbered("region", F.lit(0), 1, 5), F.lit("/3/"), found, F.lit(0))
    )
    regions = region.select(
        *page(text("/3/region/", r.cast("string"), "/"), numbered("nation", r, 5, 5), F.lit("/3/"), found, r)
    )
    nations = nation.select(
        *page(
            text("/3/nation/", n.cast("string"), "/"),
            numbered("customer", n * FANOUT, 1, FANOUT),
            text("/3/region/", (n % 5).cast("string"), "/"),
            found,
            n,
        )
    )
    up = F.when(
        c < ROOT_CUSTOMERS, text("/3/nation/", F.floor(c / FANOUT).cast("string"), "/")
    ).otherwise(
        text("/3/customer/", F.floor((c - ROOT_CUSTOMERS) / FANOUT).cast("string"), "/")
    )
    customers = customer.select(
        *page(
            text("/3/customer/", c.cast("string"), "/"),
            F.concat(
                numbered("customer", c * FANOUT + ROOT_CUSTOMERS, 1, FANOUT),
                numbered("order", c * 10, 1, 10, ".html"),
            ),
            up,
            F.when(F.col("c_acctbal") < 0, F.lit(404)).otherwise(found),
            c % 86400,
        )
    )
    order_pages = orders.select(
        *page(
            text("/3/order/", o.cast("string"), ".html"),
            F.array(text("/3/customer/", F.col("o_custkey").cast("string"), "/")),
            text("/3/customer/", F.floor(o / 10).cast("string"), "/"),
            found,
            o % 86400,
        )
    )
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(order_pages)


def shop_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt of the shop (one body, made from the first region row)."""
    return table(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit("shop.example.com").alias("domain"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
        F.lit(200).alias("status"),
        F.lit(
            "User-agent: *\nDisallow: /3/customer/1\nAllow: /3/\nDisallow: /\nCrawl-delay: 2\n"
        ).alias("body"),
    )


# -- logs and runs --------------------------------------------------------------


def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts of the order pages, in eight patterns by order key."""

    def tries(*entries) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(i + 1).alias("attempt"),
                    F.lit("response" if isinstance(e, int) else e).alias("kind"),
                    F.lit(e if isinstance(e, int) else None).cast("int").alias("status"),
                )
                for i, e in enumerate(entries)
            ]
        )

    key = F.col("o_orderkey") % 8
    pattern = (
        F.when(key == 0, tries(200))
        .when(key == 1, tries(404, 200))
        .when(key == 2, tries(500, 200))
        .when(key == 3, tries(500, 500, 500, 200))
        .when(key == 4, tries("timeout", 200))
        .when(key == 5, tries("connection", 503, 200))
        .when(key == 6, tries("error", 200))
        .otherwise(tries(503, 503, 404))
    )
    o = F.col("o_orderkey").cast("string")
    url = F.when(F.col("o_orderkey") % 97 == 0, text("not-a-valid-url-", o)).otherwise(
        text(f"{SHOP}/3/order/", o, ".html")
    )
    # An attempt is identified by the order's row and its number among at most four.
    place = F.struct(
        F.col("_row_id.file").alias("file"), (F.col("_row_id.index") * 4 + F.col("t.attempt") - 1).alias("index")
    )
    return (
        identified(table(spark, sf_dir, "orders"))
        .select("o_orderkey", ROW, url.alias("url"), F.explode(pattern).alias("t"))
        .select(
            "url",
            "t.attempt",
            "t.kind",
            "t.status",
            F.when(
                F.col("t.kind") == "response",
                # Every eleventh page is stored without a body.
                F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(
                    text("<p>", F.col("o_orderkey").cast("string"), "</p>")
                ),
            ).alias("html"),
            place.alias(ROW),
        )
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event, to the site of its user."""
    return table(spark, sf_dir, "events").select(
        text("site", F.col("user_id").cast("string"), ".example.com").alias("domain"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("arrival"),
    )


def log_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of the sites: minutes for some, none stated for others."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.filter("user_id % 4 != 3").select(
        text("site", F.col("user_id").cast("string"), ".example.com").alias("domain"),
        ((F.col("user_id") % 4) * 1800 + 0.5).cast("double").alias("delay"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl requests of all sorts, one per customer, many of them faulty."""
    c = F.col("c_custkey")
    k = c % 12
    name = c.cast("string")
    seed = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, text("ftp://h", name, ".example.com/"))
        .when(k == 2, text("HTTPS://h", name, ".example.com/"))
        .when(k == 3, text(" https://h", name, ".example.com/"))
        .when(k == 4, F.lit(None))
        .when(k == 5, text("https://h", name, ".example.com/a#b#c"))
        .when(k == 6, text("http://h", name, ".example.com/x  "))
        .otherwise(text("https://h", name, ".example.com/"))
    )
    return table(spark, sf_dir, "customer").select(
        c.alias("crawl_id"),
        seed.alias("seed_url"),
        F.when(k == 7, F.lit(-1)).when(c % 5 == 0, F.lit(None)).otherwise(F.lit(2)).cast("int").alias("max_depth"),
        F.when(k.isin(7, 8), F.lit(0)).otherwise(F.lit(10)).alias("max_pages"),
        F.when(k == 9, F.lit(0)).otherwise(F.lit(3)).alias("concurrent_requests"),
        F.when(k == 10, F.lit(-0.5)).otherwise(F.lit(0.5)).alias("politeness_delay"),
        F.when(k == 11, F.lit(0)).otherwise(F.lit(5)).alias("timeout"),
        F.lit(True).alias("respect_robots_txt"),
    )


def crawl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs, one per order; its customer is the seed. A few lack a
    status and cannot be saved."""
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    started = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + o * 1_000_001)
    n_pages = (o % 4).cast("int")
    urls = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), n_pages),
        lambda i: text(f"{SHOP}/c/", c, "/p", i.cast("string")),
    )
    page = "struct<url:string,depth:int,status_code:int,links_found:int,crawled_at:timestamp,error:string>"
    pages = F.transform(
        urls,
        lambda u: F.struct(
            u.alias("url"),
            F.lit(1).alias("depth"),
            F.lit(200).alias("status_code"),
            F.lit(0).alias("links_found"),
            started.alias("crawled_at"),
            F.lit(None).cast("string").alias("error"),
        ),
    ).cast(f"array<{page}>")
    status = (
        F.when(o % 113 == 0, F.lit(None))
        .when(F.col("o_orderstatus") == "F", F.lit("success"))
        .when(F.col("o_orderstatus") == "O", F.lit("max_pages_hit"))
        .otherwise(F.lit("max_depth_hit"))
    )
    return table(spark, sf_dir, "orders").select(
        o.alias("crawl_id"),
        F.when(F.col("o_custkey") % 3 == 0, text("https://shop.example.com/c/", c, "/?q=é&r=1"))
        .otherwise(text("http://shop.example.com/c//", c))
        .alias("seed_url"),
        status.alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.when(o % 7 == 0, F.lit(None)).otherwise(n_pages).cast("int").alias("total_pages"),
        F.lit(1).alias("max_depth_reached"),
        urls.alias("urls_visited"),
        F.array().cast("array<string>").alias("urls_failed"),
        pages.alias("pages"),
        started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + (o % 1000) * 100_000).alias("finished_at"),
        ((o % 1000) / 10).alias("duration_seconds"),
    )
