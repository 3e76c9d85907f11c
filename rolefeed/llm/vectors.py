"""Rows that carry a vector: which take part, and how Python sees them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shape(NamedTuple):
    dimensions: int
    rows: int
    largest: float  # of all components, without sign


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def is_finite(vector: Column) -> Column:
    """Not NULL, not empty, and without NULL or non-finite components. NULL vectors give NULL."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return fine & (F.size(vector) > 0)


def shape_of(rows: DataFrame, vector: str) -> Shape | None:
    """The length that most vectors have (of equally frequent ones the largest), how many have it,
    and their largest component; None without rows."""
    size = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    found = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"), F.max(size).alias("largest"))
    best = found.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return Shape(best[0].d, best[0].n, best[0].largest) if best else None


def matrix(column: pa.Array, dimensions: int, dtype=np.int64) -> np.ndarray:
    """An array column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(-1, dimensions)
