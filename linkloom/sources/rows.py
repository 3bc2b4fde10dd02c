"""Physical row identity: choosing rows by where they are stored, without moving them.

A row of a file is known by the file and its position there (``_row_id``). What decides
between rows works on narrow columns and ends in a set of ids; ``keep_rows`` and
``drop_rows`` then read the wide rows in place and let them pass or not. The set travels as
marks, one bit per row in blocks of ``BLOCK`` rows, so its size is known before it is
broadcast. Above ``MARK_BYTES`` the files are dealt into groups whose marks stay
below it, and each group is read by itself; either way every file is read once and no
wide row is exchanged or sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import written

ROW = "_row_id"
# Rows that one mark covers; a multiple of 64.
BLOCK = 1_024
# Most bytes of marks in one broadcast.
MARK_BYTES = 64 << 20


def identified(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` with ``_row_id``, a struct of ``file`` and ``index``.

    A scan knows the ids of its rows. What is derived from one keeps the column that was added to
    the scan, or makes ids of its own that are stable and unique. Any other frame is written first.
    """
    if ROW in df.columns:
        return df
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    try:
        return df.withColumn(ROW, place)
    except AnalysisException:
        return written(df, name).withColumn(ROW, place)


def row_marks(ids: DataFrame) -> DataFrame:
    """``(file, block, words)``: the bits of the given ``_row_id``\\ s, with ids repeated or not."""
    index = F.col("_row_id.index")
    bit = F.expr("shiftleft(1L, CAST(_row_id.index % 64 AS INT))")
    word = F.expr(f"_row_id.index % {BLOCK} DIV 64")
    words = [f"_w{k}" for k in range(BLOCK // 64)]
    grouped = ids.filter(index.isNotNull()).groupBy(
        F.col("_row_id.file").alias("file"), F.expr(f"_row_id.index DIV {BLOCK}").alias("block")
    )
    return grouped.agg(*[F.bit_or(F.when(word == k, bit)).alias(w) for k, w in enumerate(words)]).select(
        "file", "block", F.array(*[F.coalesce(w, F.lit(0).cast("bigint")) for w in words]).alias("words")
    )


def keep_rows(df: DataFrame, ids: DataFrame, mark_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``_row_id`` is among those of ``ids``."""
    return _chosen(df, ids, True, mark_bytes)


def drop_rows(df: DataFrame, ids: DataFrame, mark_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``_row_id`` is not among those of ``ids``."""
    return _chosen(df, ids, False, mark_bytes)


def _chosen(df: DataFrame, ids: DataFrame, keep: bool, mark_bytes: int | None) -> DataFrame:
    marks = written(row_marks(ids), "marks")
    # A mark's words, block and the row's own overhead, and the name of its file.
    size = marks.agg(F.sum(F.octet_length("file") + F.lit(BLOCK // 8 + 64))).first()[0]
    if not size:
        return df.limit(0) if keep else df
    groups = -(-size // (MARK_BYTES if mark_bytes is None else mark_bytes))
    if groups == 1:
        return _pass(df, marks, keep)

    def group(file: Column) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(groups))

    parts = [
        _pass(df.filter(group(F.col("_row_id.file")) == g), marks.filter(group(F.col("file")) == g), keep)
        for g in range(groups)
    ]
    return reduce(DataFrame.union, parts)


def _pass(df: DataFrame, marks: DataFrame, keep: bool) -> DataFrame:
    marks = marks.select(F.struct("file", "block").alias("_at"), F.col("words").alias("_words"))
    at = F.struct(F.col("_row_id.file").alias("file"), F.expr(f"_row_id.index DIV {BLOCK}").alias("block"))
    held = df.join(F.broadcast(marks), at == F.col("_at"), "left")
    marked = F.expr(f"getbit(_words[CAST(_row_id.index % {BLOCK} DIV 64 AS INT)], CAST(_row_id.index % 64 AS INT)) = 1")
    marked = F.coalesce(marked, F.lit(False))
    return held.filter(marked if keep else ~marked).select(*df.columns)
