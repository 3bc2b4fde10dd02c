"""The k-th row of each key, without sorting a key.

Every round cuts the rows that are left of a key at about ``PIVOTS`` of its own rows, counts
what lies between the cuts, and goes on with the one interval that holds the k-th row. Counts are
combined before they move, and what is left shrinks by about that factor a round; a key with at most
``SORTED`` rows left is ranked by a window. So neither a sort nor a task ever holds
a large key, and the number of rounds grows with the logarithm of its size.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import written

PIVOTS = 64
SORTED = 100_000


def kth(rows: DataFrame, key: str, order: str, wanted: DataFrame, sorted_rows: int | None = None) -> DataFrame:
    """``(key, order)``: of each key in ``wanted(key, k)`` its k-th smallest ``order``, from 1.

    ``order`` is unique within a key; keys with fewer than k rows are absent.
    """
    least = SORTED if sorted_rows is None else sorted_rows
    left = rows.select(key, order).join(wanted.select(key, F.col("k").cast("bigint").alias("_k")), key)
    sizes = written(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("_k").alias("_k")), "sizes")
    found: list[DataFrame] = []
    for step in count():
        small = sizes.filter(F.col("_n") <= least).select(key)
        found.append(written(_ranked(left.join(small, key, "left_semi"), key, order), "kth"))
        large = sizes.filter((F.col("_n") > least) & (F.col("_k") <= F.col("_n")))
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        left = written(_narrowed(left, key, order, large, step), "interval")
        sizes = written(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("_k").alias("_k")), "sizes")


def _ranked(left: DataFrame, key: str, order: str) -> DataFrame:
    ranked = left.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked.filter("_rank = _k").select(key, order)


def _narrowed(left: DataFrame, key: str, order: str, large: DataFrame, step: int) -> DataFrame:
    """The rows of the interval that holds the k-th one, with ``_k`` counted from its start."""
    left = left.drop("_k")
    # Rows are drawn by their hash in this round, so that runs agree; the share falls with the size of the key.
    drawn = F.pmod(F.xxhash64(F.col(order), F.lit(step)), F.col("_n")) < PIVOTS
    cuts = (
        left.join(large, key)
        .filter(drawn)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(order)).alias("_cuts"))
    )
    none = F.array().cast(f"array<{dict(left.dtypes)[order]}>")
    cuts = written(large.join(cuts, key, "left").select(key, "_k", F.coalesce("_cuts", none).alias("_cuts")), "cuts")
    placed = left.join(cuts, key).withColumn(
        "_place", F.size(F.filter("_cuts", lambda c: c < F.col(order))).cast("bigint")
    )
    counts = placed.groupBy(key, "_place", "_k").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per key and cut.
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_place")) - F.col("_n")
    holds = (F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_n"))
    interval = counts.withColumn("_before", before).filter(holds)
    interval = interval.select(key, "_place", (F.col("_k") - F.col("_before")).alias("_k"))
    return placed.drop("_k", "_cuts").join(interval, [key, "_place"]).select(key, order, "_k")
