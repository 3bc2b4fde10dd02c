"""Running aggregates over keys that may hold a large share of all rows.

A plain window sorts each key in one task. Where some key is too large for
that, the rows are range-partitioned by key and order instead, so that a large
key covers many even chunks; each chunk runs its own window, and one carry per
chunk brings in what came before. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import written

# Largest number of rows of one key that a single window task should sort.
WINDOW_ROWS = 2_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest key (combined before the shuffle)."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    return top.first()["n"] or 0


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    *,
    before: bool = False,
    largest: int | None = None,
    window_rows: int | None = None,
) -> DataFrame:
    """Add running aggregates per key in the given order.

    ``values`` maps a new column to ``("sum" | "max" | "min", expression)``.
    With ``before`` a row does not count itself. ``order`` must be unique within
    a key. Sums start at 0, the others at null. A caller that knows the size of
    the largest key passes it as ``largest``.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if largest is None and limit > 0:
        # Counted from the written rows, so what is upstream runs once.
        df = written(df, "running")
        largest = largest_group(df, keys)
    if largest is not None and largest <= limit:
        return _within(df, keys, order, values, before)
    return _chunked(df, keys, order, values, before)


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}


def _within(df, keys, order, values, before) -> DataFrame:
    last = -1 if before else W.currentRow
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, last)
    return df.withColumns(
        {
            name: _start(kind, _AGGREGATES[kind](expr).over(window))
            for name, (kind, expr) in values.items()
        }
    )


def _start(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + right
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def _chunked(df, keys, order, values, before) -> DataFrame:
    # The chunk numbers are written once: a second run of the range sampling
    # must not number the rows differently.
    chunks = written(
        df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()),
        "chunks",
    )
    names = list(values)
    totals = chunks.groupBy(*keys, "_chunk").agg(
        *[_AGGREGATES[values[n][0]](values[n][1]).alias(f"_t_{n}") for n in names]
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # Only keys that go on from an earlier chunk have a carry: at most one row
    # per chunk, so this side of the join is bounded by the partition count.
    carries = (
        totals.select(
            *keys,
            "_chunk",
            F.count(F.lit(1)).over(earlier).alias("_n"),
            *[
                _AGGREGATES[values[n][0]](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}")
                for n in names
            ],
        )
        .filter("_n > 0")
        .drop("_n")
    )
    local = _within(chunks, [*keys, "_chunk"], order, values, before)
    # A null key is a key like others.
    carries = carries.select(F.struct(*keys, "_chunk").alias("_carried"), *[f"_c_{n}" for n in names])
    joined = local.join(F.broadcast(carries), F.struct(*keys, "_chunk").eqNullSafe(F.col("_carried")), "left")
    return joined.withColumns(
        {n: _combine(values[n][0], F.col(f"_c_{n}"), F.col(n)) for n in names}
    ).select(*df.columns, *names)
