"""Repeated strings of a fixed length by prefix doubling over sampled positions.

Spark groups positions by their rank at growing lengths (``LADDER``, the last being
the threshold) and reranks those that are not yet decided. A rank at a length is
named by a polynomial hash of that many bytes, so that the rank of a pair of adjoining
stretches needs no join, and only positions whose rank is shared go on.

Sorting every position at every length would move many times the text. At length K
it is enough to rank one position for each window of threshold bytes, the start of
the smallest K-gram inside it: equal windows choose the same place. Windows next to
each other mostly share it, so a position stands for a run of windows, and the bytes
that these cover are its context. At each length

* a rank that no other position has is unique: its windows do not repeat;
* positions with the same rank and context are copies: all their windows repeat;
* where a rank has several contexts, one position of each goes on to the next length.

At the last length a context is the window itself and nothing is left open. Groups
of copies, however large, go on as one position with a weight. Counts are combined
before the shuffle; no pairs are formed.

Texts meet the open positions and the final spans by a broadcast of these while they
have at most ``BROADCAST_ROWS`` rows (they are counted), so that texts need not
move; beyond that by a shuffled join with the same result.

Defined results: null and empty texts, and those below the threshold, have no
windows; rows with the same key and text are separate documents, so both lose
their bytes; texts of any length are read in overlapping slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import row_key
from linkloom.session import written

LENGTH = 200
LADDER = (64, 160, 192, 200)
BROADCAST_ROWS = 1_000_000
# Bytes ranked at a time, few enough for the arrays to stay in the cache.
SLICE = 120_000

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype="uint64")
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class _Hashes:
    """Hashes of byte stretches from prefix sums modulo 2**64."""

    def __init__(self, size: int):
        random = np.random.default_rng(7)
        self.value = random.integers(0, 1 << 63, 256, dtype="uint64")
        self.up, self.down = _powers(_BASE, size + 1), _powers(pow(_BASE, -1, 1 << 64), size + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.__init__(2 * len(data))
        sums = np.zeros(len(data) + 1, dtype="uint64")
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def stretches(self, sums: np.ndarray, begins: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        places = self.down[: len(sums)][begins]
        return _mixed((sums[ends] - sums[begins]) * places)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    count = len(keys) - width + 1
    if width == 1:
        return keys
    filled = np.append(keys, np.full(-len(keys) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    back = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def ranked(pieces: list[bytes], k: int, length: int, hashes: _Hashes) -> tuple[np.ndarray, ...]:
    """For each run of windows that choose one position: piece, first and last window
    (in the piece), rank of the position at length ``k``, and hash of the context."""
    data = np.frombuffer(b"".join(pieces), dtype="uint8")
    if len(data) < length:
        empty = np.empty(0, dtype="int64")
        return empty, empty, empty, empty, empty
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    sums = hashes.prefix(data)
    grams = hashes.stretches(sums, slice(0, len(data) - k + 1), slice(k, None))
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype="uint64")
    chosen = (_smallest(keys, length - k + 1) & _PLACE).astype("int64")
    windows = np.arange(len(chosen))
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(chosen)]
    inside = windows + length <= ends[owner]
    windows, chosen, owner = windows[inside], chosen[inside], owner[inside]
    if not len(windows):
        return windows, windows, windows, windows, windows
    first = np.flatnonzero(np.append(True, (np.diff(chosen) != 0) | (np.diff(windows) != 1)))
    last = np.append(first[1:], len(chosen)) - 1
    low, high, at = windows[first], windows[last], chosen[first]
    context = hashes.stretches(sums, low, high + length)
    # Where the position stands in its context, and how long that is, belong to it.
    context = _mixed(context + (at - low).astype("uint64") * np.uint64(1_000_003) + (high - low).astype("uint64"))
    begin = (ends - sizes)[owner[first]]
    return owner[first], low - begin, high - begin, grams[at].view("int64"), context.view("int64")


def _ranker(k: int, length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(2 * (SLICE + length))
        for batch in batches:
            bases, data = batch.column("_base").to_pylist(), batch.column("_data")
            rows, starts, pieces, held = [], [], [], 0
            for row in range(len(batch)):
                value = data[row].as_py() or b""
                # A long text is read in slices that overlap by a window.
                for start in range(0, max(1, len(value) - length + 1), SLICE):
                    piece = value[start : start + SLICE + length - 1]
                    rows.append(row)
                    starts.append(bases[row] + start)
                    pieces.append(piece)
                    held += len(piece)
                    if held >= SLICE:
                        yield _ranks(batch, rows, starts, ranked(pieces, k, length, hashes))
                        rows, starts, pieces, held = [], [], [], 0
            if pieces:
                yield _ranks(batch, rows, starts, ranked(pieces, k, length, hashes))

    return work


def _ranks(batch: pa.RecordBatch, rows: list[int], starts: list[int], found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    piece, low, high, rank, context = found
    at = pa.array(np.array(rows, dtype="int64")[piece])
    start = np.array(starts, dtype="int64")[piece]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_id").take(at),
            batch.column("_hash").take(at),
            batch.column("_weight").take(at),
            pa.array(start + low),
            pa.array(start + high),
            pa.array(rank),
            pa.array(context),
        ],
        names=["_id", "_hash", "_weight", "_low", "_high", "_rank", "_context"],
    )


def _positions(stretches: DataFrame, k: int, length: int) -> DataFrame:
    """Ranked positions of rows ``_id, _hash, _weight, _base, _data``."""
    kind = stretches.schema["_id"].dataType.simpleString()
    return stretches.select("_id", "_hash", "_weight", "_base", "_data").mapInArrow(
        _ranker(k, length), f"_id {kind}, _hash long, _weight long, _low long, _high long, _rank long, _context long"
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """``_id, _hash`` and ``spans``, the maximal stretches (begin, end) of bytes that lie in repeated strings."""
    texts = docs.select(
        *row_key(key, text),
        F.lit(1).cast("long").alias("_weight"),
        F.lit(0).cast("long").alias("_base"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"),
    )
    found = []
    stretches = texts
    for k in ladder:
        positions = _positions(stretches, k, length)
        shared = positions.groupBy("_rank").agg(F.sum("_weight").alias("_w")).filter("_w > 1").select("_rank")
        shared = written(shared, "ranks")
        positions = written(positions.join(shared, "_rank", "left_semi"), "positions")
        contexts = positions.groupBy("_rank", "_context").agg(F.sum("_weight").alias("_w"))
        several = contexts.groupBy("_rank").agg(F.count(F.lit(1)).alias("_m"))
        contexts = contexts.join(several, "_rank")
        placed = written(positions.join(contexts, ["_rank", "_context"]), "placed")
        found.append(placed.filter("_w > 1").select("_id", "_hash", "_low", (F.col("_high") + length).alias("_end")))
        if k == length:
            break
        open_ = placed.filter("_m > 1").groupBy("_rank", "_context").agg(
            F.min(F.struct("_id", "_hash", "_low", "_high")).alias("p"), F.least(F.lit(2), F.max("_w")).alias("_weight")
        )
        open_ = written(open_.select("p.*", F.col("_weight").cast("long").alias("_weight")), "open")
        stretches = written(_cut(stretches, open_, length), "stretches")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return written(_merged(every), "spans")


def _cut(stretches: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts of the open positions, as stretches of their own."""
    base = stretches.select(
        F.col("_id").alias("_sid"),
        F.col("_hash").alias("_shash"),
        "_base",
        (F.col("_base") + F.octet_length("_data")).alias("_stop"),
        "_data",
    )
    inside = (
        F.col("_id").eqNullSafe(F.col("_sid"))
        & (F.col("_hash") == F.col("_shash"))
        & (F.col("_low") >= F.col("_base"))
        & (F.col("_high") + length <= F.col("_stop"))
    )
    cut = F.substring("_data", (F.col("_low") - F.col("_base") + 1).cast("int"), (F.col("_high") - F.col("_low") + length).cast("int"))
    pieces = base.join(_small(wanted), inside).select("_id", "_hash", "_weight", F.col("_low").alias("_base"), cut.alias("_data"))
    # Stretches of one document may overlap, and rows may repeat: one copy of each piece.
    return pieces.groupBy("_id", "_hash", "_base", F.octet_length("_data").alias("_n")).agg(
        F.max("_weight").alias("_weight"), F.first("_data").alias("_data")
    )


def _merged(parts: DataFrame) -> DataFrame:
    """Overlapping and touching stretches joined, per document."""
    document = W.partitionBy("_id", "_hash").orderBy("_low", "_end")
    before = document.rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_reach", F.max("_end").over(before))
    new = (F.col("_reach").isNull() | (F.col("_low") > F.col("_reach"))).cast("int")
    parts = parts.withColumn("_run", F.sum(new).over(document))
    runs = parts.groupBy("_id", "_hash", "_run").agg(F.min("_low").alias("begin"), F.max("_end").alias("end"))
    return runs.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` removed and ``kept``, the remaining bytes."""
    found = spans(docs, key, text, length, ladder).select(F.col("_id").alias("_sid"), F.col("_hash").alias("_shash"), "spans")
    rows = docs.select(*row_key(key, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    same = F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_hash") == F.col("_shash"))
    rows = rows.join(_small(found), same, "left")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("spans", found.schema["spans"].dataType, False),
            T.StructField("kept", T.BinaryType(), False),
        ]
    )
    return rows.select("_id", "_data", "spans").mapInArrow(_remover(schema), schema)


def _remover(schema: T.StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            kept, sizes = [], []
            for data, runs in zip(batch.column("_data"), lists.to_pylist()):
                value = data.as_py()
                sizes.append(len(value))
                if runs:
                    at, parts = 0, []
                    for run in runs:
                        parts.append(value[at : run["begin"]])
                        at = run["end"]
                    value = b"".join([*parts, value[at:]])
                kept.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([x or [] for x in lists.to_pylist()], lists.type),
                    pa.array(kept, pa.binary()),
                ],
                names=schema.names,
            )

    return work
