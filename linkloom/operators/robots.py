"""robots.txt bodies as rule tables, and the checks that use them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import after, over, percent_decode_keep_plus, strip
from linkloom.session import written

SCHEMA = "domain STRING, fetched_at TIMESTAMP, status INT, body STRING"
RULES_SCHEMA = (
    "domain STRING, agents ARRAY<STRING>, delay BIGINT, "
    "rules ARRAY<STRUCT<path: STRING, allow: BOOLEAN>>"
)

# Line keys of the format.
AGENT_KEY = "user-agent"
RULE_KEYS = ("allow", "disallow", "crawl-delay", "request-rate")

# Rules of a domain that each of its URLs may scan.
SCANNED_RULES = 100

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _tidy_path(path: Column) -> Column:
    """Drop empty trailing ``;``, ``?`` and ``#`` marks, as a URL round trip does."""
    path = U.split_ready(path)
    path = F.regexp_replace(path, r"(?s)^([^#]*)#\z", "$1")
    path = F.regexp_replace(path, r"(?s)^([^?#]*)\?(?=#|\z)", "$1")
    return F.regexp_replace(path, r"(?s)^([^?#;]*/)?([^/?#;]*);(?=[?#]|\z)", "$1$2")


def match_target(url: Column) -> Column:
    """What rules are matched against: all behind the authority, decoded."""
    decoded = U.split_ready(percent_decode_keep_plus(url))
    target = _tidy_path(
        F.regexp_replace(decoded, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?", "")
    )
    return (
        F.when(target == "", F.lit("/"))
        .when(target.startswith("//"), F.concat(F.lit("//"), target))
        .otherwise(target)
    )


def latest_robots(robots: DataFrame) -> DataFrame:
    """The newest fetch per domain."""
    columns = [c for c in robots.columns if c != "domain"]
    # In a struct an unknown time is the oldest.
    newest = robots.groupBy("domain").agg(
        F.max_by(F.struct(*columns), F.struct("fetched_at")).alias("newest")
    )
    return newest.select("domain", *[F.col(f"newest.{c}").alias(c) for c in columns])


def robots_groups(robots: DataFrame) -> DataFrame:
    """``(domain, fetched_at, group_no, agents, delay, rules)``: the rule groups
    of each body with status 200, in file order.

    A group starts at an empty line or at an agent line that follows a rule.
    The windows run within one body.
    """
    body = ["domain", "fetched_at"]
    lines = robots.filter("status = 200 AND body IS NOT NULL").select(
        *body, F.posexplode(F.split("body", _LINE_BREAK)).alias("line_no", "line")
    )
    content = strip(F.substring_index("line", "#", 1))
    lines = lines.withColumn("content", content)
    pair = F.col("content").contains(":")
    key = F.lower(strip(F.substring_index("content", ":", 1)))
    keyed = lines.select(
        *body,
        "line_no",
        (F.col("line") == "").alias("empty"),
        F.when(pair & key.isin(AGENT_KEY, *RULE_KEYS), key).alias("key"),
        F.when(pair, percent_decode_keep_plus(strip(after(F.col("content"), ":")))).alias("value"),
    ).filter("empty OR key IS NOT NULL")
    in_order = W.partitionBy(*body).orderBy("line_no")
    starts = F.col("empty") | (
        (F.col("key") == AGENT_KEY) & F.lag("key").over(in_order).isin(*RULE_KEYS)
    )
    grouped = keyed.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn(
        "group_no", F.count_if("starts").over(in_order)
    )
    path_rule = F.col("key").isin("allow", "disallow")
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    rule = F.struct(
        F.col("line_no"), _tidy_path(F.col("value")).alias("path"), allow.alias("allow")
    )
    digits = (F.col("key") == "crawl-delay") & strip(F.col("value")).rlike("^[0-9]+$")
    delay = F.when(digits, F.expr("try_cast(trim(value) AS BIGINT)"))
    groups = grouped.groupBy(*body, "group_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("key") == AGENT_KEY, F.struct("line_no", "value"))))
        .getField("value")
        .alias("agents"),
        F.max_by(delay, F.when(digits, F.col("line_no"))).alias("delay"),
        F.array_sort(F.collect_list(F.when(path_rule, rule))).alias("rules"),
        F.count_if(F.col("key").isin(*RULE_KEYS)).alias("n_rules"),
    )
    return groups.filter((F.size("agents") > 0) & (F.col("n_rules") > 0)).select(
        *body,
        "group_no",
        "agents",
        "delay",
        F.transform("rules", lambda r: F.struct(r["path"].alias("path"), r["allow"].alias("allow")))
        .alias("rules"),
    )


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """``(domain, agents, delay, rules)``: the group that applies to ``agent``.

    That is the first group naming the agent (a name matches when it is part of
    the agent's token), else the first ``*`` group. Domains without one are
    absent, which means everything is allowed.
    """
    token = F.lit(agent.split("/")[0].lower())
    groups = robots_groups(latest_robots(robots))
    fallback = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: token.contains(F.lower(a)))
    applies = groups.filter(fallback | named)
    order = F.struct(fallback.alias("fallback"), F.col("group_no"))
    chosen = applies.groupBy("domain").agg(
        F.min_by(F.struct("agents", "delay", "rules"), order).alias("g")
    )
    return chosen.select("domain", "g.agents", "g.delay", "g.rules")


def rule_verdict(target: Column, rules: Column) -> Column:
    """Verdict of the first rule whose path is a prefix; allowed without one."""
    hits = F.filter(rules, lambda r: target.startswith(r["path"]))
    return F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))


def _scanned(url: Column, rules: Column) -> Column:
    return F.when(rules.isNull(), F.lit(True)).otherwise(rule_verdict(match_target(url), rules))


@dataclass
class RuleIndex:
    """Rule tables ready for look-ups, by ``_domain``.

    ``short`` has the rules of domains with few of them as an array, which is scanned. Of the others
    ``paths`` has a row per rule path with its first line, and ``lengths`` the lengths of the
    domain's paths; both are None where no domain has that many rules.
    """

    short: DataFrame
    paths: DataFrame | None = None
    lengths: DataFrame | None = None


def rule_index(rules: DataFrame, scanned: int = SCANNED_RULES) -> RuleIndex:
    """Written tables of ``rules(domain, rules)`` for ``robots_checked``."""
    held = written(rules.select(F.col("domain").alias("_domain"), "rules"), "rules")
    long = held.filter(F.size("rules") > scanned)
    if long.isEmpty():
        return RuleIndex(held)
    lines = long.select("_domain", F.posexplode("rules").alias("line", "rule"))
    first = F.min(F.struct("line", "rule.allow")).alias("first")
    paths = written(lines.groupBy("_domain", F.col("rule.path").alias("_prefix")).agg(first), "rule-paths")
    lengths = paths.groupBy("_domain").agg(F.collect_set(F.char_length("_prefix")).alias("_lengths"))
    return RuleIndex(held.filter(F.size("rules") <= scanned), paths, written(lengths, "rule-lengths"))


def robots_checked(urls: DataFrame, index: RuleIndex, url: str = "url") -> DataFrame:
    """Add ``allowed`` to rows with a ``_domain``: the verdict of the first rule whose path is a prefix.

    In a domain with very many rules a URL's prefixes, of the lengths that occur there, meet
    the rule paths by equality and the smallest line wins, so no URL scans the rules. Each
    distinct target is looked up once.
    """
    target = over(match_target, url)
    checked = urls.join(index.short, "_domain", "left")
    allowed = over(_scanned, url, "rules")
    if index.paths is None:
        return checked.withColumn("allowed", allowed).drop("rules")
    asked = urls.select("_domain", target.alias("_target")).join(index.lengths, "_domain").distinct()
    usable = F.filter("_lengths", lambda n: n <= F.char_length("_target"))
    prefixes = F.transform(usable, lambda n: F.substring(F.col("_target"), F.lit(1), n))
    hits = asked.select("_domain", "_target", F.explode(prefixes).alias("_prefix")).join(index.paths, ["_domain", "_prefix"])
    found = hits.groupBy("_domain", "_target").agg(F.min("first").alias("_first"))
    return (
        checked.withColumn("_target", target)
        .join(found, ["_domain", "_target"], "left")
        .withColumn("allowed", F.when(F.col("_first").isNotNull(), F.col("_first.allow")).otherwise(allowed))
        .drop("rules", "_target", "_first")
        .select(*urls.columns, "allowed")
    )


def robots_allowed(urls: DataFrame, rules: DataFrame | RuleIndex, url: str = "url") -> DataFrame:
    """Add ``allowed``. A boolean column ``respect_robots_txt``, where present
    and false, allows the row's URL without a check.

    The rule table has one row per domain; the optimizer broadcasts it while it
    is small, and otherwise splits domains with very many URLs.
    """
    index = rules if isinstance(rules, RuleIndex) else rule_index(rules)
    checked = robots_checked(urls.withColumn("_domain", over(U.url_domain, url)), index, url).drop("_domain")
    if "respect_robots_txt" in urls.columns:
        allowed = ~F.coalesce("respect_robots_txt", F.lit(True)) | F.col("allowed")
        checked = checked.withColumn("allowed", allowed)
    return checked


def crawl_delay(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``delay``, the crawl delay of the domain's rules, or null."""
    found = domains.join(rules.select("domain", "delay"), "domain", "left")
    if "respect_robots_txt" in domains.columns:
        found = found.withColumn(
            "delay", F.when(F.coalesce("respect_robots_txt", F.lit(True)), F.col("delay"))
        )
    return found


def domain_delays(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``(crawl_id, domain, delay)``: seconds between requests to a domain, the
    larger of the crawl's own delay and a non-zero robots delay."""
    domains = requests.withColumn("domain", over(U.url_domain, "seed_url"))
    own = F.col("politeness_delay")
    robots_delay = F.when(F.col("delay") != 0, F.col("delay").cast("double"))
    return crawl_delay(domains, rules).select(
        "crawl_id",
        "domain",
        F.greatest(own, F.coalesce(robots_delay, own)).alias("delay"),
    )
