"""Vector compression to short codes, with memoised grid cells for the nearest codebook entry.

A vector is cut into consecutive parts of equal length, and every part position has a
codebook. A code names, part by part, the nearest entry. Vectors are integers,
``floor(scale * x)``; all distances are exact.

The space of a part is cut into a grid of cells of side ``CELL``. A cell's coordinates
are hashed; the first time a task meets a cell it bounds the distance of every entry to any point
of the cell's box, from below and from above. An entry whose lower bound is above the least
upper bound is dominated across the box and cannot win there. The others are remembered with
the cell, and only they are compared with the cell's parts. A part with a coordinate beyond
``FAR`` cells is compared with all entries. Both give the same result, ties to the lower index.

A round is one pass over the written integers in Arrow batches: a task returns a count and
sums per entry, at most ``parts`` x ``entries`` rows, Spark adds them up, and only these sums reach the driver.
Neither copies of a vector nor a frequent cell make anything move or grow.

Defined results: vectors that are null or hold a null or non-finite component are left out, and so
are those of another length than ``size``, which have no such parts. Components are held to the limit of ``vectors.LIMIT``.
The codebooks start with the rows of the smallest keys (null keys last, equal keys in the order of their vectors); with fewer
rows than ``entries`` there are as many entries as rows. Entries without parts stay. Repeated
rows each have their row; an empty table gives none. Of the other columns only those named in ``carry`` come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.vectors import matrix, usable, whole
from linkloom.session import written

CELL = 32
# Cells that a coordinate may lie from the origin to have a packed hash.
FAR = 1 << 14
# Cells that a task remembers per part position.
REMEMBERED = 50_000


@dataclass
class Coding:
    """``members`` has the key, carried columns, ``code`` (bytes, one per part) and ``error`` (squared)
    of every vector, in a written table; ``codebooks`` are indexed by part, entry and position."""

    members: DataFrame
    codebooks: np.ndarray


class Cells:
    """The cells of one part position that a task has met, with the entries not dominated in them."""

    def __init__(self, book: np.ndarray, remembered: int | None = None):
        self.book = book
        self.remembered = REMEMBERED if remembered is None else remembered
        # Bits of a coordinate in the hash: equal hashes are equal cells.
        self.bits = 63 // book.shape[1]
        self.far = min(FAR, 1 << (self.bits - 1))
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.begin = np.empty(0, dtype="int64")
        self.count = np.empty(0, dtype="int64")
        self.entries = np.empty(0, dtype="int64")

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every part."""
        cells = parts // CELL
        near = ((cells >= -self.far) & (cells < self.far)).all(axis=1)
        index = np.zeros(len(parts), dtype="int64")
        least = np.zeros(len(parts), dtype="int64")
        if near.any():
            index[near], least[near] = self._within(parts[near], cells[near])
        for k in np.flatnonzero(~near).tolist():
            distances = ((self.book - parts[k]) ** 2).sum(axis=1)
            index[k] = distances.argmin()
            least[k] = distances[index[k]]
        return index, least

    def _within(self, parts: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.zeros(len(parts), dtype="int64")
        for column in (cells + self.far).T:
            packed = (packed << self.bits) | column
        hashes, first, which = np.unique(packed, return_index=True, return_inverse=True)
        if len(self.slots) + len(hashes) > self.remembered:
            self.clear()
        new = [k for k, h in enumerate(hashes.tolist()) if h not in self.slots]
        if new:
            self._learn(hashes[new], cells[first[new]])
        slot = np.array([self.slots[h] for h in hashes.tolist()], dtype="int64")[which]
        count = self.count[slot]
        ends = np.cumsum(count)
        row = np.repeat(np.arange(len(parts)), count)
        entry = self.entries[np.repeat(self.begin[slot] - (ends - count), count) + np.arange(len(row))]
        distances = ((parts[row] - self.book[entry]) ** 2).sum(axis=1)
        # Distance first, then the index: the least of both is the lower index among equals.
        best = np.minimum.reduceat(distances * len(self.book) + entry, ends - count)
        return best % len(self.book), best // len(self.book)

    def _learn(self, hashes: np.ndarray, cells: np.ndarray) -> None:
        low = cells[:, None] * CELL
        high = low + (CELL - 1)
        nearest = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        farthest = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
        bound = (farthest**2).sum(axis=2).min(axis=1)
        cell, entry = np.nonzero((nearest**2).sum(axis=2) <= bound[:, None])
        count = np.bincount(cell, minlength=len(cells))
        self.slots.update(zip(hashes.tolist(), range(len(self.begin), len(self.begin) + len(hashes))))
        self.begin = np.append(self.begin, len(self.entries) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.entries = np.append(self.entries, entry)


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    size: int = 64,
    scale: int = 256,
    carry: tuple[str, ...] = (),
) -> Coding:
    """Codes of all vectors and the codebooks after ``rounds`` rounds; see the module's text."""
    if size % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide the components evenly, and entries fit a byte")
    kept = vectors.filter(usable(vectors[vector], size))
    table = written(
        kept.select(kept[key], *[kept[c] for c in carry], whole(kept[vector], scale).alias("_v")), "integers"
    )
    first = table.select(key, "_v").orderBy(F.col(key).asc_nulls_last(), "_v").limit(entries).collect()
    books = np.array([r["_v"] for r in first], dtype="int64").reshape(-1, parts, size // parts).swapaxes(0, 1).copy()
    for _ in range(rounds if books.size else 0):
        updated = books.copy()
        for r in _sums(table, books).collect():
            updated[r["part"], r["entry"]] = np.array(r[3:], dtype="int64") // r["n"]
        books = updated
    return Coding(written(_assigned(table, key, carry, books), "codes"), books)


def _coded(vectors: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part, one column per part."""
    width = vectors.shape[1] // len(cells)
    found = [c.nearest(vectors[:, p * width : (p + 1) * width]) for p, c in enumerate(cells)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(table: DataFrame, books: np.ndarray) -> DataFrame:
    """``part``, ``entry``, ``n`` and the sums of the components of its parts, for every entry in use."""
    n_parts, n_entries, width = books.shape
    names = [f"s{d}" for d in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        counts = np.zeros(n_parts * n_entries, dtype="int64")
        sums = np.zeros((n_parts * n_entries, width), dtype="int64")
        for batch in batches:
            vectors = matrix(batch.column("_v"), n_parts * width)
            if not len(vectors):
                continue
            index, _ = _coded(vectors, cells)
            number = (index + np.arange(n_parts) * n_entries).ravel()
            by = np.argsort(number, kind="stable")
            begins = np.flatnonzero(np.diff(number[by], prepend=-1))
            sums[number[by][begins]] += np.add.reduceat(vectors.reshape(-1, width)[by], begins, axis=0)
            counts += np.bincount(number, minlength=len(counts))
        used = np.flatnonzero(counts)
        columns = [used // n_entries, used % n_entries, counts[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *names])

    found = table.select("_v").mapInArrow(work, ", ".join(f"{n} long" for n in ["part", "entry", "n", *names]))
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])


def _assigned(table: DataFrame, key: str, carry: tuple[str, ...], books: np.ndarray) -> DataFrame:
    n_parts, _, width = books.shape
    names = [key, *carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            vectors = matrix(batch.column("_v"), n_parts * width)
            index, least = _coded(vectors, cells) if len(vectors) else (vectors[:, :n_parts], vectors[:, :n_parts])
            code = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(n_parts), len(vectors), [None, pa.py_buffer(index.astype("uint8").tobytes())]
            ).cast(pa.binary())
            columns = [*(batch.column(n) for n in names), code, pa.array(least.sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "code", "error"])

    schema = T.StructType([table.schema[n] for n in names])
    return table.mapInArrow(work, schema.add("code", T.BinaryType()).add("error", T.LongType()))
