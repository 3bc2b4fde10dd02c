"""Running sums in a global or per-key order, without one task per key.

Rows are range-partitioned by key and order, so that a large key covers many
even chunks. Each chunk runs its own window; a carry for what came before is
added. Only keys that reach over a chunk's end have carries, at most one per
chunk, so that side of the join is bounded by the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import written


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add sums up to and including each row. Rows that tie in ``order`` follow in any order."""
    chunks = written(
        df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()), "chunks"
    )
    names = list(values)
    totals = chunks.groupBy(*keys, "_chunk").agg(*[F.sum(values[n]).alias(f"_t_{n}") for n in names])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_at"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in names],
    ).filter(F.col(f"_c_{names[0]}").isNotNull())
    within = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = chunks.withColumns({n: F.sum(values[n]).over(within) for n in names})
    # Null keys are keys like others.
    same = F.col("_chunk") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(F.broadcast(carries), same, "left")
    return joined.select(
        *df.columns, *[(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in names]
    )
