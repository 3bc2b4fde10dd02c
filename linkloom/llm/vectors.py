"""Vectors as whole numbers, for the operators that work on them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Components are held to this size (2^16 before a scale of 256), so that squared
# distances of 64 components, and 64 times them, fit a long.
LIMIT = 1 << 24


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none null or non-finite."""
    numbers = vector.cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, computed in doubles, as integers within ``LIMIT``."""

    def one(x: Column) -> Column:
        scaled = F.least(F.greatest(x * F.lit(float(scale)), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
        return F.floor(scaled).cast("int")

    return F.transform(vector.cast("array<double>"), one)


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """A column of lists of ``size`` integers as a table of longs."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(-1, size)


def decimals(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.ravel().tolist()))
