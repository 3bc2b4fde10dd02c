"""Fetch attempts: retry outcome, retry budget, visited and failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.session import written
from linkloom.sources.rows import ROW, identified, keep_rows

SCHEMA = "url STRING, attempt INT, kind STRING, status INT, html STRING"

# Attempts per URL and seconds before the first retry.
MAX_ATTEMPTS = 3
RETRY_SECONDS = 2


def _terminal() -> Column:
    """A response below 500 or an unexpected error ends the attempts."""
    response = (F.col("kind") == "response") & (F.col("status") < 500)
    return response | (F.col("kind") == "error")


def winning_attempts(attempts: DataFrame) -> DataFrame:
    """``(url, status, has_body, _row_id)``, one row per URL: its first terminal one of the first attempts.

    An error, no terminal attempt or an invalid URL give status -1. ``has_body`` says whether
    the attempt's body counts, which those of client errors and empty ones do not; ``_row_id``
    is where it is stored. Of a body only this flag takes part.
    """
    rows = identified(attempts, "attempts")
    fetched = F.col("kind") == "response"
    body = fetched & (F.col("status") < 400) & (F.coalesce(F.col("html"), F.lit("")) != "")
    narrow = rows.select(
        "url",
        "attempt",
        ((F.col("attempt") <= MAX_ATTEMPTS) & _terminal()).alias("ends"),
        F.when(fetched, F.col("status")).otherwise(F.lit(-1)).cast("int").alias("status"),
        F.coalesce(body, F.lit(False)).alias("has_body"),
        ROW,
    )
    first = F.min(F.when(F.col("ends"), F.struct("attempt", ROW, "status", "has_body")))
    found = narrow.groupBy("url").agg(first.alias("won"))
    valid = over(U.is_valid_url, "url") & F.col("won").isNotNull()
    return found.select(
        "url",
        F.when(valid, F.col("won.status")).otherwise(F.lit(-1)).alias("status"),
        F.when(valid, F.col("won.has_body")).otherwise(F.lit(False)).alias("has_body"),
        F.col(f"won.{ROW}").alias(ROW),
    )


def fetch_outcome(attempts: DataFrame) -> DataFrame:
    """``(url, status, html)``: the winning attempt of each URL (see ``winning_attempts``).

    4xx bodies are blank, and so is the body of a URL without a response. Winners are chosen
    from narrow rows; their bodies are then read where they are stored, and never exchanged.
    """
    rows = identified(attempts, "attempts")
    won = written(winning_attempts(rows), "winners")
    bodies = keep_rows(rows, won.filter("has_body").select(ROW))
    bare = won.filter("NOT has_body")
    return bodies.select("url", F.col("status").cast("int").alias("status"), "html").unionByName(
        bare.select("url", "status", F.lit("").alias("html"))
    )


def retry_budget(attempts: DataFrame) -> DataFrame:
    """``(url, attempts_used, backoff_seconds)``: attempts up to the terminal
    one, and the doubling waits after each earlier one. Invalid URLs use none."""
    counted = F.col("attempt") <= MAX_ATTEMPTS
    used = attempts.groupBy("url").agg(
        F.min(F.when(counted & _terminal(), F.col("attempt"))).alias("ended"),
        F.max(F.when(counted, F.col("attempt"))).alias("last"),
    )
    tries = F.when(
        over(U.is_valid_url, "url"), F.coalesce("ended", "last", F.lit(0))
    ).otherwise(F.lit(0))
    # A wait follows every non-terminal attempt but the last one allowed.
    waits = F.least(
        F.when(F.col("ended").isNotNull(), F.col("tries") - 1).otherwise(F.col("tries")),
        F.lit(MAX_ATTEMPTS - 1),
    )
    return used.withColumn("tries", tries).select(
        "url",
        F.col("tries").cast("bigint").alias("attempts_used"),
        (RETRY_SECONDS * (F.pow(F.lit(2), F.greatest(waits, F.lit(0))) - 1))
        .cast("bigint")
        .alias("backoff_seconds"),
    )


def split_outcomes(outcomes: DataFrame) -> DataFrame:
    """Add ``outcome``: visited needs a response and a body, else failed.

    Takes outcomes with bodies, or winning attempts, whose flag ``has_body`` is enough.
    """
    if "has_body" in outcomes.columns:
        body = F.col("has_body")
    else:
        body = F.coalesce(F.col("html"), F.lit("")) != ""
    ok = (F.col("status") != -1) & body
    return outcomes.withColumn(
        "outcome", F.when(ok, F.lit("visited")).otherwise(F.lit("failed"))
    )
