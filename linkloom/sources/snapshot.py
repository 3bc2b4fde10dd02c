"""The page snapshot: what a fetch of a canonical URL gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.functions.columns import over
from linkloom.session import written
from linkloom.sources.rows import ROW, drop_rows, identified

SCHEMA = "url STRING, status INT, html STRING, fetched_at TIMESTAMP"


def _fetched_at(df: DataFrame) -> Column:
    if "fetched_at" in df.columns:
        return F.col("fetched_at")
    return F.lit(None).cast("timestamp").alias("fetched_at")


def page_snapshot(pages: DataFrame) -> DataFrame:
    """``(url, status, html, fetched_at)``, one row per canonical URL.

    ``pages`` has ``page_id, url, html`` and optionally ``status`` (else 200)
    and ``fetched_at`` (else null). A page stored with a client error (4xx) keeps
    its status and has no body; one with a server error (5xx and above) is a
    failed fetch: status -1, no body.

    Among rows with one canonical URL the smallest ``page_id`` counts, ids that are
    null last, and of rows with the same id the first one stored. The others are found
    from narrow columns and left out where they are read (see ``rows``); no body
    is moved. Pass the scan itself, or what is derived from it with its row ids.
    """
    rows = identified(pages, "pages")
    status = F.col("status").cast("int") if "status" in pages.columns else F.lit(200)
    keyed = rows.select(
        over(U.canonical_url, "url").alias("url"),
        "page_id",
        status.alias("status"),
        "html",
        _fetched_at(pages),
        ROW,
    ).filter(F.col("url").isNotNull())
    later = later_rows(keyed, "page_id")
    kept = keyed if later is None else drop_rows(keyed, later)
    failed = F.col("status") >= 500
    return kept.select(
        "url",
        F.when(failed, F.lit(-1)).otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") >= 400, F.lit("")).otherwise(F.col("html")).alias("html"),
        "fetched_at",
    )


def later_rows(rows: DataFrame, rank: str, key: str = "url") -> DataFrame | None:
    """``_row_id`` of every row but the first of its key: the smallest ``rank``, nulls last, then the
    smallest row id. None if no key is repeated, which one grouped pass over narrow columns tells."""
    named = rows.select(key, F.col(rank).alias("_rank"), ROW)
    repeated = named.groupBy(key).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = written(repeated.filter("_n > 1").drop("_n"), "repeated")
    if repeated.isEmpty():
        return None
    # From here on only rows of repeated keys take part.
    rivals = written(named.join(repeated, key), "rivals")
    best = rivals.filter(F.col("_rank").eqNullSafe(F.col("_first"))).groupBy(key).agg(F.min(ROW).alias("_best"))
    return rivals.join(best, key).filter(F.col(ROW) != F.col("_best")).select(ROW)


def snapshot_from_outcomes(outcomes: DataFrame) -> DataFrame:
    """Snapshot from resolved fetch attempts (one outcome per URL as requested).

    Of requested URLs with one canonical form the first in order counts.
    """
    rows = identified(outcomes, "outcomes")
    keyed = rows.select(
        over(U.canonical_url, "url").alias("url"),
        F.col("url").alias("_asked"),
        F.col("status").cast("int").alias("status"),
        "html",
        _fetched_at(outcomes),
        ROW,
    ).filter(F.col("url").isNotNull())
    later = later_rows(keyed, "_asked")
    kept = keyed if later is None else drop_rows(keyed, later)
    return kept.select("url", "status", "html", "fetched_at")
