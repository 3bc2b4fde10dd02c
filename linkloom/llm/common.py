"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(key: str, text: str) -> list[Column]:
    """``_id`` and ``_hash``, which tell rows apart by key and whole text.

    Rows with the same key and text count as one document.
    """
    return [F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_hash")]


def with_text(rows: DataFrame, schema: T.StructType, text: str, new: Column) -> DataFrame:
    """The documents held whole in ``doc``, with a new text and ``n_chars`` to match."""
    columns = []
    for field in schema.fields:
        value = F.col("doc")[field.name]
        if field.name == text:
            value = new
        elif field.name == "n_chars":
            value = F.char_length(new).cast(field.dataType)
        columns.append(value.alias(field.name))
    return rows.select(*columns)
