"""Running aggregates, politeness, robots refetching and fetch attempts against
plain loops, on both the plain and the spread way."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import fetchlog, politeness
from linkloom.operators.running import running


@pytest.mark.parametrize("window_rows", [None, 0])
@pytest.mark.parametrize("before", [False, True])
def test_running_equals_loop(spark, window_rows, before):
    rng = random.Random(1)
    # One key holds most rows.
    rows = [(0 if rng.random() < 0.7 else rng.randrange(40), i, rng.randrange(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(5)
    values = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.when(F.col("v") > 0, F.col("v")))}
    out = running(df, ["k"], ["i"], values, before=before, window_rows=window_rows)
    got = {(r.k, r.i): (r.s, r.hi, r.lo) for r in out.collect()}
    want, state = {}, {}
    for k, i, v in rows:
        s, hi, lo = state.get(k, (0, None, None))
        after = (s + v, v if hi is None else max(hi, v), (v if lo is None else min(lo, v)) if v > 0 else lo)
        want[k, i] = (s, hi, lo) if before else after
        state[k] = after
    assert got == want


def random_log(rng, n, span):
    rows = []
    for i in range(n):
        domain = "hot.org" if rng.random() < 0.6 else f"d{rng.randrange(6)}.org"
        rows.append((domain, i, rng.randrange(span) * 250_000))
    return rows


def log_frame(spark, rows):
    df = spark.createDataFrame(rows, "domain string, seq long, at long")
    return df.select("domain", "seq", F.timestamp_micros("at").alias("arrival")).repartition(4)


@pytest.mark.parametrize("window_rows", [None, 0])
def test_schedule_equals_loop(spark, window_rows):
    rows = random_log(random.Random(2), 1200, 2000)
    delay = {"hot.org": 0.4, "d1.org": 2.0, "d2.org": 0.0, "d3.org": 33.125}
    delays = spark.createDataFrame(list(delay.items()), "domain string, delay double")
    out = politeness.politeness_schedule(log_frame(spark, rows), delays, 1.0, window_rows=window_rows)
    got = {(r.domain, r.seq): (r.at, round(r.wait_seconds, 6)) for r in out.withColumn("at", F.unix_micros("start_at")).collect()}
    want, last = {}, {}
    for domain, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start = at
        if domain in last:
            start = max(at, last[domain] + round(delay.get(domain, 1.0) * 1_000_000))
        last[domain] = start
        want[domain, seq] = (start, round((start - at) / 1e6, 6))
    assert got == want


@pytest.mark.parametrize("window_rows", [None, 0])
@pytest.mark.parametrize("ttl", [0, 7, 60])
def test_fetch_plan_equals_loop(spark, window_rows, ttl):
    rows = random_log(random.Random(ttl), 1500, 3000)
    out = politeness.robots_fetch_plan(log_frame(spark, rows), ttl, window_rows)
    got = {(r.domain, r.seq): r.fetches for r in out.collect()}
    want, last = {}, {}
    for domain, seq, at in sorted(rows, key=lambda r: (r[2], r[1])):
        want[domain, seq] = domain not in last or at - last[domain] >= ttl * 1_000_000
        if want[domain, seq]:
            last[domain] = at
    assert got == want


def test_null_domain_is_a_domain(spark):
    rows = [(None, 1, 0), (None, 2, 5), (None, 3, 4_000_000_000), ("p.test", 4, 3)]
    for window_rows in (None, 0):
        out = politeness.robots_fetch_plan(log_frame(spark, rows), window_rows=window_rows)
        assert {r.seq for r in out.filter("fetches").collect()} == {1, 3, 4} and out.count() == 4


@pytest.mark.parametrize("gap, ttl", [(1, 50), (7, 3), (400, 1_000)])
def test_one_domain_in_many_chunks(spark, monkeypatch, gap, ttl):
    """Chunks shorter and longer than what a fetch lasts."""
    rng = random.Random(gap)
    at = sorted(rng.sample(range(3_000 * gap), 2_000))
    rows = [("hot.org", k, t * 1_000_000) for k, t in enumerate(at)] + [("a.org", 5_000 + k, t) for k, t in enumerate(at[:50])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = politeness.robots_fetch_plan(log_frame(spark, rows), ttl, window_rows=0)
        got = {r.seq for r in out.filter("fetches AND domain = 'hot.org'").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = set(), None
    for k, t in enumerate(at):
        if last is None or t - last >= ttl:
            want.add(k)
            last = t
    assert got == want


def test_fetch_plan_literal(spark):
    rows = [("p.test", 11, 0), ("p.test", 12, 40), ("p.test", 13, 80), ("q.test", 14, 7), ("r.test", 15, 0), ("r.test", 16, 7_200_000_000)]
    out = politeness.robots_fetch_plan(log_frame(spark, rows))
    assert {r.seq for r in out.filter("fetches").collect()} == {11, 14, 15, 16}


def test_equal_arrivals(spark):
    rows = [("p.test", 2, 5), ("p.test", 1, 5), ("p.test", 3, 5)]
    cached = politeness.robots_fetch_plan(log_frame(spark, rows), 60)
    assert {r.seq for r in cached.filter("fetches").collect()} == {1}
    assert politeness.robots_fetch_plan(log_frame(spark, rows), 0).filter("fetches").count() == 3


def test_delays_belong_to_crawls(spark):
    rows = [(1, "p.test", 1, 0), (1, "p.test", 2, 0), (2, "p.test", 3, 0), (2, "p.test", 4, 0)]
    log = spark.createDataFrame(rows, "crawl_id long, domain string, seq long, at long").select(
        "crawl_id", "domain", "seq", F.timestamp_micros("at").alias("arrival")
    )
    delays = spark.createDataFrame([(1, "p.test", 2.0), (2, "p.test", 9.0)], "crawl_id long, domain string, delay double")
    waits = {r.seq: r.wait_seconds for r in politeness.politeness_schedule(log, delays).collect()}
    assert waits == {1: 0.0, 2: 2.0, 3: 0.0, 4: 9.0}
    # Without crawls a domain has one queue, and no row is multiplied.
    shared = politeness.politeness_schedule(log.drop("crawl_id"), delays)
    assert sorted(r.wait_seconds for r in shared.collect()) == [0.0, 9.0, 18.0, 27.0]


ATTEMPTS = {
    "http://m.test/fine": [("response", 204)],
    "no scheme at all": [("response", 200)],
    "http://m.test/gone": [("response", 410), ("response", 200)],
    "http://m.test/down": [("response", 502), ("response", 503), ("response", 500), ("response", 200)],
    "http://m.test/back": [("response", 503), ("response", 200)],
    "http://m.test/slow": [("timeout", None), ("response", 200)],
    "http://m.test/cut": [("connection", None), ("error", None), ("response", 200)],
    "http://m.test/moved": [("response", 302)],
}


def test_fetch_attempts_literal(spark):
    body = "<i>leaf</i>"
    rows = [
        (u, i + 1, kind, status, body if kind == "response" else None)
        for u, tries in ATTEMPTS.items()
        for i, (kind, status) in enumerate(tries)
    ]
    df = spark.createDataFrame(rows, fetchlog.SCHEMA).repartition(3)
    want = {  # status, body, attempts used, seconds waited
        "http://m.test/fine": (204, body, 1, 0), "no scheme at all": (-1, "", 0, 0), "http://m.test/gone": (410, "", 1, 0),
        "http://m.test/down": (-1, "", 3, 6), "http://m.test/back": (200, body, 2, 2), "http://m.test/slow": (200, body, 2, 2),
        "http://m.test/cut": (-1, "", 2, 2), "http://m.test/moved": (302, body, 1, 0),
    }
    outcome = {r.url: (r.status, r.html) for r in fetchlog.fetch_outcome(df).collect()}
    assert outcome == {u: w[:2] for u, w in want.items()}
    budget = {r.url: (r.attempts_used, r.backoff_seconds) for r in fetchlog.retry_budget(df).collect()}
    assert budget == {u: w[2:] for u, w in want.items()}
    split = {r.url: r.outcome for r in fetchlog.split_outcomes(fetchlog.fetch_outcome(df)).collect()}
    assert split["http://m.test/gone"] == "failed" and split["http://m.test/moved"] == "visited"
