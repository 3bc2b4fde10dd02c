"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Queries run ``$BENCH_RUNS`` times (3), and the median counts; a crawl runs once.
``plan`` is the part of a query's time that building its plan takes.
"""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkloom import catalog  # noqa: E402
from linkloom.session import local_session  # noqa: E402

HEADLINES = (
    "canonicalize_urls link_graph classify_counts robots_allowed politeness_schedule "
    "robots_fetch_plan fetch_outcome load_latest"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # One untimed job starts the JVM's workers; every timed query does all its work.
    run(catalog.QUERIES["domain_rollup"](spark, sf))
    seconds, planning = {}, {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        return result

    for name in HEADLINES:
        took, built = [], []
        for _ in range(runs):
            start = time.perf_counter()
            df = catalog.QUERIES[name](spark, sf)
            df._jdf.queryExecution().executedPlan()
            built.append(time.perf_counter() - start)
            run(df)
            took.append(time.perf_counter() - start)
        seconds[name], planning[name] = round(median(took), 3), round(median(built), 3)
        print(name, seconds[name], planning[name], file=sys.stderr, flush=True)

    def crawl(make):
        crawled = make(spark, sf)
        run(crawled.page_records())
        return crawled

    shop = timed("crawl_shop", lambda: crawl(catalog.crawl_shop))
    timed("crawl_hosts", lambda: crawl(catalog.crawl_hosts))
    pages = shop.visited().count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "plan": planning,
                "sf": os.path.basename(sf.rstrip("/")),
                "crawl_shop_pages": pages,
                "crawl_shop_pages_per_sec": round(pages / seconds["crawl_shop"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
