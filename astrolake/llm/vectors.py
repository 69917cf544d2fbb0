"""Vectors in Spark columns: which of them can be computed with, and how tasks take them up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(v: Column, most: Column) -> Column:
    """The array<double> is not null and all its components are numbers of at most ``most`` in size; an empty one is fine.

    ``array_contains`` is null for arrays that hold nulls, and nan is the largest of doubles, so three plain functions tell."""
    inside = ~F.array_contains(v, float("nan")) & (F.array_max(v) <= most) & (F.array_min(v) >= -most)
    return F.coalesce((F.size(v) == 0) | inside, F.lit(False))


def by_dimension(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix of doubles) of a list column without nulls."""
    size = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat, offsets = np.asarray(vectors.flatten(), np.float64), np.r_[0, np.cumsum(size)]
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, flat[offsets[rows][:, None] + np.arange(dim)]
