"""Robots rules against literal cases and the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from linkloom.operators import robots as R

RULED = "# cellar\nUser-agent: *\nCrawl-delay: 6\nAllow: /cellar/door\nDisallow: /cellar\n"
OPEN = "User-agent: *\nAllow: /\n"


def table(spark, bodies):
    rows = [(d, status, body) for d, (status, body) in bodies.items()]
    df = spark.createDataFrame(rows, "domain string, status int, body string")
    return df.withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp"))


def verdicts(spark, bodies, urls, agent="*"):
    rules = R.robots_rules(table(spark, bodies), agent)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: r.allowed for r in R.robots_allowed(df, rules).collect()}


def delays(spark, bodies, agent="*"):
    rules = R.robots_rules(table(spark, bodies), agent)
    domains = spark.createDataFrame([(d,) for d in bodies], "domain string")
    return {r.domain: r.delay for r in R.crawl_delay(domains, rules).collect()}


def test_literal_cases(spark):
    bodies = {"ruled.test": (200, RULED), "open.test": (200, OPEN), "gone.test": (410, RULED), "down.test": (503, RULED)}
    want = {
        "https://ruled.test/attic": True, "https://ruled.test/cellar/wine?year=1": False, "https://ruled.test/cellar/door": True,
        "https://open.test/cellar": True, "https://gone.test/cellar": True, "https://down.test/cellar": True, "https://silent.test/cellar": True,
    }
    assert verdicts(spark, bodies, list(want)) == want
    assert delays(spark, bodies) == {"ruled.test": 6, "open.test": None, "gone.test": None, "down.test": None}


def test_flag_off_allows(spark):
    rules = R.robots_rules(table(spark, {"ruled.test": (200, RULED)}))
    df = spark.createDataFrame(
        [("https://ruled.test/cellar", False), ("https://ruled.test/cellar", True)], "url string, respect_robots_txt boolean"
    )
    got = {r.respect_robots_txt: r.allowed for r in R.robots_allowed(df, rules).collect()}
    assert got == {False: True, True: False}
    domains = spark.createDataFrame([("ruled.test", False)], "domain string, respect_robots_txt boolean")
    assert R.crawl_delay(domains, rules).first().delay is None


def test_delay_is_the_larger_one(spark):
    bodies = {"a.org": (200, "User-agent: *\nCrawl-delay: 3"), "b.org": (200, "User-agent: *\nCrawl-delay: 1"),
              "c.org": (200, "User-agent: *\nCrawl-delay: 0")}
    requests = spark.createDataFrame(
        [(1, "https://a.org/", 1.0), (2, "https://b.org/", 2.0), (3, "https://c.org/", 0.5), (4, "https://x.org/", 1.5)],
        "crawl_id long, seed_url string, politeness_delay double",
    )
    got = {r.crawl_id: r.delay for r in R.domain_delays(requests, R.robots_rules(table(spark, bodies))).collect()}
    assert got == {1: 3.0, 2: 2.0, 3: 0.5, 4: 1.5}


def test_newest_body_counts(spark):
    rows = [("d.org", "2026-01-01", 200, "User-agent: *\nDisallow: /"), ("d.org", "2026-01-02", 200, "User-agent: *\nAllow: /"),
            ("e.org", "2026-01-01", 200, "User-agent: *\nDisallow: /"), ("e.org", "2026-01-03", 404, "")]
    df = spark.createDataFrame(rows, "domain string, fetched_at string, status int, body string")
    rules = R.robots_rules(df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")))
    assert [r.domain for r in rules.collect()] == ["d.org"]
    assert rules.first().rules[0].allow is True


def random_body(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.randint(0, 9)
        path = rng.choice(["", "/", "/a", "/a/b", "/b?x=1", "/%61", "*", "/a*", "/c;p", "/ü", "/a b", "?", "/d#x", "/a;"])
        if kind <= 2:
            lines.append(rng.choice(["User-agent: ", "user-AGENT:", " User-Agent : "]) + rng.choice(["*", "bot", "Other", "mybot", ""]))
        elif kind <= 6:
            lines.append(rng.choice(["Disallow: ", "Allow: ", "disallow:"]) + path + rng.choice(["", " # c"]))
        elif kind == 7:
            lines.append("Crawl-delay: " + rng.choice(["1", "7", "x", "2.5", "%32", ""]))
        elif kind == 8:
            lines.append(rng.choice(["", "", "   ", "# comment", "Sitemap: http://x/", "Nonsense", "Request-rate: 1/5"]))
        else:
            lines.append("")
    return rng.choice(["\n", "\r\n", "\r"]).join(lines)


def test_random_bodies_equal_stdlib(spark):
    rng = random.Random(3)
    bodies = {f"h{i}.org": (200, random_body(rng)) for i in range(400)}
    paths = ["/", "/a", "/a/b/c", "/b?x=1", "/b?y=2", "/c", "/%C3%BC", "/a%20b", "/a%2Ab", "/d%23x", "//a", "/a?", "/c%3Bp", "/zz"]
    urls = [f"http://{d}{p}" for d in bodies for p in paths]
    for agent in ("*", "MyBot/1.0"):
        want, want_delay = {}, {}
        for d, (_, body) in bodies.items():
            parser = RobotFileParser()
            parser.parse(body.splitlines())
            want_delay[d] = parser.crawl_delay(agent)
            want.update({f"http://{d}{p}": parser.can_fetch(agent, f"http://{d}{p}") for p in paths})
        got = verdicts(spark, bodies, urls, agent)
        bad = [(u, got[u], want[u], bodies[u.split("/")[2]][1]) for u in urls if got[u] != want[u]]
        assert not bad, bad[:3]
        assert delays(spark, bodies, agent) == want_delay


@pytest.mark.parametrize("scanned", [0, 3, 100])
def test_indexed_rules_equal_scanned_ones(spark, scanned):
    rng = random.Random(8)
    segments = ["", "a", "b", "a/b", "ü", "a*", "b?x", "%2F"]
    bodies = {}
    for i in range(12):
        lines = [f"{rng.choice(['Allow', 'Disallow'])}: /{rng.choice(segments)}{rng.choice(['', '/', '/c'])}" for _ in range(rng.randint(0, 9))]
        bodies[f"h{i}.org"] = "\n".join(["User-agent: *", *lines])
    bodies["many.org"] = "User-agent: *\n" + "\n".join(f"Disallow: /p{k}/\nAllow: /p{k}/open" for k in range(3_000)) + "\nAllow: /p7/"
    paths = ["/", "/a", "/a/b/c", "/b?x=1", "/b/", "/%C3%BC/c", "/a*", "/zz", "", "/p7/x", "/p7/open", "/p2999/", "/q"]
    urls = spark.createDataFrame([(f"http://{d}{p}",) for d in [*bodies, "none.org"] for p in paths] * 2, "url string")
    table = spark.createDataFrame([(d, None, 200, b) for d, b in bodies.items()], R.SCHEMA)
    rules = R.robots_rules(table)
    index = R.rule_index(rules, scanned)
    assert index.paths is not None
    got = R.robots_allowed(urls, index)
    want = R.robots_allowed(urls, R.rule_index(rules, 10**9))
    assert got.columns == ["url", "allowed"] and got.count() == urls.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    verdict = {r.url: r.allowed for r in got.collect()}
    assert not verdict["http://many.org/p7/open"] and verdict["http://many.org/q"] and not verdict["http://many.org/p2999/"]
