"""Crawl requests: defaults, validation and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.columns import strip

SCHEMA = (
    "crawl_id BIGINT, seed_url STRING, max_depth INT, max_pages INT, "
    "concurrent_requests INT, politeness_delay DOUBLE, timeout INT, "
    "headers MAP<STRING,STRING>, proxy STRING, respect_robots_txt BOOLEAN"
)

# What a request gets for a setting it leaves out.
DEFAULTS = {
    "max_depth": 4,
    "max_pages": 1000,
    "concurrent_requests": 10,
    "politeness_delay": 1.0,
    "timeout": 30,
    "respect_robots_txt": True,
}


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill settings that are missing or null."""
    types = {
        "max_depth": "int",
        "max_pages": "int",
        "concurrent_requests": "int",
        "politeness_delay": "double",
        "timeout": "int",
        "respect_robots_txt": "boolean",
    }
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)).cast(types[name])
        if name in requests.columns
        else F.lit(value).cast(types[name])
        for name, value in DEFAULTS.items()
    }
    return requests.withColumns(filled)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``error``: the message of the first rule a request breaks, or null.

    Seeds of good requests are trimmed and lose their fragment.
    """
    seed = F.col("seed_url")
    # The rules in order, with their messages.
    error = (
        F.when(F.coalesce(seed, F.lit("")) == "", F.lit("seed_url cannot be empty"))
        .when(
            ~(seed.startswith("http://") | seed.startswith("https://")),
            F.concat(F.lit("seed_url must start with http:// or https://: "), seed),
        )
        .when(F.col("max_depth") < 0, F.lit("max_depth cannot be negative"))
        .when(F.col("max_pages") < 1, F.lit("max_pages must be at least 1"))
        .when(
            F.col("concurrent_requests") < 1,
            F.lit("concurrent_requests must be at least 1"),
        )
        .when(
            F.col("politeness_delay") < 0, F.lit("politeness_delay cannot be negative")
        )
        .when(F.col("timeout") < 1, F.lit("timeout must be at least 1 second"))
    )
    return (
        with_defaults(requests)
        .withColumn("error", error)
        .withColumn(
            "seed_url",
            F.when(
                F.col("error").isNull(), F.substring_index(strip(seed), "#", 1)
            ).otherwise(seed),
        )
    )


def accepted_requests(requests: DataFrame) -> DataFrame:
    """The valid requests, ready to crawl."""
    return validate_requests(requests).filter("error IS NULL").drop("error")
