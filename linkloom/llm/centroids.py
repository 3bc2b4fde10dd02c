"""Centroid clustering with a Walsh-Hadamard progressive search for the nearest centroid.

Every vector becomes integers, ``floor(scale * x)``, and these are transformed once by
the Walsh-Hadamard matrix, ordered by the number of sign changes, so that the coarse
coefficients come first. The transform is exact in integers and keeps distances up to
the factor ``size``: the squared differences of all coefficients sum to ``size`` times the
squared distance. Only the coefficients are stored.

For a vector, the squared differences to all centroids are summed over the coarse
coefficients. The centroid that is closest so far is finished, and its full sum bounds
the least one. Centroids whose partial sum is above the bound are strictly worse and
leave; the others take the next, finer coefficients, until all ``size`` are in. Equal sums
stay to the end, where the smaller number wins.

A round is one pass over the written coefficients in Arrow batches. A task adds up its
vectors by centroid and returns at most one row per centroid; Spark sums these, and only
the ``k`` sums reach the driver (the transform is linear, so the sums of coefficients give
those of the components). What moves does not grow with copies of a vector or with a
cluster's size.

Defined results: vectors that are null, have another number of components, or hold a null
or non-finite one are left out; so an empty table gives no rows. Components are held to
the limit of ``vectors.LIMIT``. Repeated rows are points of their own, also as first centroids. First
centroids are the vectors with the smallest hash of their key, equal hashes in the order of
the vectors; a null key is hashed as the empty string. With fewer than ``k`` vectors there are as
many centroids as vectors. A centroid without vectors stays where it is. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.vectors import matrix, usable, whole
from linkloom.session import written

# Share of the coefficients that is in after each step.
STEPS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
# Vectors compared at once.
ROWS = 2_048


@dataclass
class Clustering:
    """``members`` has the key, ``cluster`` and ``distance`` (squared) of every vector, in a
    written table; ``centroids`` are the final ones, integers, one row each."""

    members: DataFrame
    centroids: np.ndarray


def sequency(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix by their number of sign changes."""
    if size < 1 or size & (size - 1):
        raise ValueError(f"the number of components must be a power of two, not {size}")
    signs = transformed(np.eye(size, dtype="int64"), None)
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(rows: np.ndarray, order: np.ndarray | None) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, by butterflies of sums and differences."""
    out = rows.astype("int64")
    size, half = rows.shape[1], 1
    while half < size:
        pairs = out.reshape(len(rows), size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        out = out.reshape(len(rows), size)
        half *= 2
    return out if order is None else out[:, order]


def restored(coefficients: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows whose transforms are given."""
    natural = np.empty_like(coefficients)
    natural[:, order] = coefficients
    return transformed(natural, None) // coefficients.shape[1]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and ``size`` times the squared distance, from coefficients."""
    number = np.zeros(len(rows), dtype="int64")
    least = np.zeros(len(rows), dtype="int64")
    for at in range(0, len(rows), ROWS):
        number[at : at + ROWS], least[at : at + ROWS] = _search(rows[at : at + ROWS], centroids)
    return number, least


def _search(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = rows.shape[1]
    ends = sorted({max(1, round(size * share)) for share in STEPS})
    partial = np.zeros((len(rows), len(centroids)), dtype="int64")
    for k in range(ends[0]):
        partial += (rows[:, k, None] - centroids[:, k]) ** 2
    closest = partial.argmin(axis=1)
    bound = ((rows - centroids[closest]) ** 2).sum(axis=1)
    row, other = np.nonzero(partial <= bound[:, None])
    sums = partial[row, other]
    for begin, end in pairwise(ends):
        sums = sums + ((rows[row, begin:end] - centroids[other, begin:end]) ** 2).sum(axis=1)
        left = sums <= bound[row]
        row, other, sums = row[left], other[left], sums[left]
    # Pairs are in order of vector and centroid; every vector has at least the one that gave its bound.
    starts = np.searchsorted(row, np.arange(len(rows)))
    least = np.minimum.reduceat(sums, starts)
    winners = np.flatnonzero(sums == least[row])
    first = winners[np.searchsorted(row[winners], np.arange(len(rows)))]
    return other[first], least


def clusters(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    size: int = 64,
    scale: int = 256,
    seed: str = "2:",
) -> Clustering:
    """Lloyd's rounds from the ``k`` vectors of smallest hash; see the module's text."""
    order = sequency(size)
    table = written(_transformed(vectors, key, vector, size, scale, order), "coefficients")
    name = F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    first = table.orderBy(F.sha2(name.cast("binary"), 256), "_c").limit(k).collect()
    held = np.array([r["_c"] for r in first], dtype="int64").reshape(-1, size)
    centroids = restored(held, order)
    for _ in range(rounds if len(held) else 0):
        for r in _sums(table, held).collect():
            sums = restored(np.array([r[2:]], dtype="int64"), order)[0]
            centroids[r["c"]] = sums // r["n"]
        held = transformed(centroids, order)
    return Clustering(written(_assigned(table, key, held), "members"), centroids)


def _transformed(vectors: DataFrame, key: str, vector: str, size: int, scale: int, order: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = transformed(matrix(batch.column("_v"), size), order).astype("int32")
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype="int32") * size, rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "_c"])

    kept = vectors.filter(usable(vectors[vector], size))
    kept = kept.select(kept[key], whole(kept[vector], scale).alias("_v"))
    return kept.mapInArrow(work, T.StructType([kept.schema[key], T.StructField("_c", T.ArrayType(T.IntegerType(), False))]))


def _sums(table: DataFrame, held: np.ndarray) -> DataFrame:
    """``c``, ``n`` and the sums of the coefficients of the vectors nearest to each centroid that has any."""
    size = held.shape[1]
    names = [f"s{d}" for d in range(size)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(held), dtype="int64")
        sums = np.zeros(held.shape, dtype="int64")
        for batch in batches:
            rows = matrix(batch.column("_c"), size)
            number, _ = nearest(rows, held)
            counts += np.bincount(number, minlength=len(held))
            by = np.argsort(number, kind="stable")
            begins = np.flatnonzero(np.diff(number[by], prepend=-1))
            if len(begins):
                sums[number[by][begins]] += np.add.reduceat(rows[by], begins, axis=0)
        used = np.flatnonzero(counts)
        columns = [used, counts[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c", "n", *names])

    parts = table.select("_c").mapInArrow(work, ", ".join(f"{n} long" for n in ["c", "n", *names]))
    return parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])


def _assigned(table: DataFrame, key: str, held: np.ndarray) -> DataFrame:
    size = held.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, least = nearest(matrix(batch.column("_c"), size), held)
            columns = [batch.column(key), pa.array(number, pa.int32()), pa.array(least // size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance"])

    schema = T.StructType([table.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return table.mapInArrow(work, schema)
