"""Whitening of embeddings by polarisation covariances.

Components become integers, so all statistics are exact. Over the distinct integer vectors one
pass gives the sum of every dimension; a second one squares, after centring, every dimension and
the sum of every pair of dimensions. As ``var(a + b) = var(a) + var(b) + 2 cov(a, b)``, differences
of these variances are the covariances. Only they meet floating point, when their eigenvectors are
taken on the driver.

Values are centred on the integer below their mean; the rest, less than 1, is added exactly in
whole numbers: with ``y = x - floor(S / n)`` and ``r = S mod n``,
``sum((n x - S)^2) = n (n sum(y^2) - r^2)``.

Size: a task sends one number per pair of dimensions, and the driver holds the square matrix that
an eigenvalue solver needs, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefeed.llm.rows import add_columns, fresh
from rolefeed.llm.vectors import as_doubles, is_finite, matrix, shape_of
from rolefeed.session import settle

STEP, SHIFT = 64, 1_000_000
COMPONENTS = 16
CHUNK_ROWS = 1024
# A component whose variance is this small a share of the largest is rounding, and has no axis.
FLAT = 1e-10

_SAFE = 1 << 62
TOTALS = "i int, j int, total decimal(38,0)"


class Whitening(NamedTuple):
    """A fitted whitening. ``centres * n + rests`` are the sums of the dimensions."""

    n: int
    centres: np.ndarray
    rests: np.ndarray
    axes: np.ndarray  # dimensions x components, unit eigenvectors
    variances: np.ndarray  # of the components
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.centres

    def whitened(self, y: np.ndarray) -> np.ndarray:
        exact = y - self.rests / self.n
        return exact @ self.axes / np.sqrt(self.variances)

    def deviations(self, y: np.ndarray) -> list[int]:
        """``sum((n x - S)^2)`` of every row, exact."""
        highest = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if highest * highest * y.shape[1] < _SAFE:
            scaled = self.n * y - self.rests
            return np.einsum("ij,ij->i", scaled, scaled).tolist()
        return [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rests)) for row in y]


def _parts(batches, dimensions: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK_ROWS):
            yield matrix(batch.slice(low, CHUNK_ROWS).column(0), dimensions)


def _column_sums(values: np.ndarray, bound: int) -> list[int]:
    """Exact sums of columns of integers whose size is at most ``bound``."""
    if bound * len(values) < _SAFE:
        return values.sum(axis=0).tolist()
    return [sum(map(int, column)) for column in values.T]


def _square_sums(values: np.ndarray, bound: int) -> list[int]:
    if bound * bound * len(values) < _SAFE:
        return np.einsum("ij,ij->j", values, values).tolist()
    return [sum(int(v) ** 2 for v in column) for column in values.T]


def _record(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = zip(*totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(t) for t in totals.values()], pa.decimal128(38, 0))],
        names=["i", "j", "total"],
    )


def _collected(parts: DataFrame) -> dict[tuple[int, int], int]:
    summed = parts.groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r.i, r.j): int(r.total) for r in summed.collect()}


def sums(fit_list: DataFrame, dimensions: int, bound: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of every dimension."""
    def run(batches):
        totals = {(-1, -1): 0, **{(i, i): 0 for i in range(dimensions)}}
        for x in _parts(batches, dimensions):
            totals[-1, -1] += len(x)
            for i, total in enumerate(_column_sums(x, bound)):
                totals[i, i] += total
        yield _record(totals)

    found = _collected(fit_list.mapInArrow(run, TOTALS))
    return found.get((-1, -1), 0), [found.get((i, i), 0) for i in range(dimensions)]


def square_sums(fit_list: DataFrame, centres: np.ndarray, bound: int) -> dict[tuple[int, int], int]:
    """For ``i <= j``: the sum of squares of the sum of two centred dimensions. ``(i, i)`` is the
    dimension alone."""
    d = len(centres)

    def run(batches):
        totals = {(i, j): 0 for i in range(d) for j in range(i, d)}
        for x in _parts(batches, d):
            y = x - centres
            for i in range(d):
                pairs = y[:, i:] + y[:, i:i + 1]
                pairs[:, 0] = y[:, i]
                for j, total in enumerate(_square_sums(pairs, 2 * bound), start=i):
                    totals[i, j] += total
        yield _record(totals)

    return _collected(fit_list.mapInArrow(run, TOTALS))


def covariances(n: int, rests: list[int], squares: dict[tuple[int, int], int]) -> tuple[np.ndarray, float]:
    """The covariance matrix and its trace, from whole numbers and rounded once."""
    d = len(rests)
    # n^2 times the variance of a dimension, and of the sum of two.
    alone = [n * squares[i, i] - rests[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = alone[i] / (n * n)
        for j in range(i + 1, d):
            both = n * squares[i, j] - (rests[i] + rests[j]) ** 2
            out[i, j] = out[j, i] = (both - alone[i] - alone[j]) / (2 * n * n)
    return out, sum(alone) / (n * n)


def fit(fit_list: DataFrame, dimensions: int, bound: int, components: int = COMPONENTS) -> Whitening | None:
    """A whitening of the rows of ``fit_list``, whose one column holds integer vectors of at most
    ``bound``; None without rows. Directions without variance give no component."""
    n, totals = sums(fit_list, dimensions, bound)
    if not n:
        return None
    centres, rests = [t // n for t in totals], [t % n for t in totals]
    v, trace = covariances(n, rests, square_sums(fit_list, np.array(centres, dtype=np.int64), 2 * bound))
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(FLAT * values.max(), 0)]
    return Whitening(
        n, np.array(centres, dtype=np.int64), np.array(rests, dtype=np.int64), axes[:, order], values[order],
        values[order] / trace if trace else values[order],
    )


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows, as measured over them, is from the identity:
    the largest absolute entry of the difference."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batches):
        mean, square = np.zeros(k), np.zeros((k, k))
        for x in _parts(batches, len(model.centres)):
            z = model.whitened(model.centred(x))
            mean += z.sum(axis=0)
            square += z.T @ z
        both = np.concatenate([mean, square.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], names=["slot", "total"])

    totals = fit_list.mapInArrow(run, "slot int, total double").groupBy("slot").agg(F.sum("total").alias("total"))
    flat = np.array([r.total for r in totals.orderBy("slot").collect()]) / model.n
    mean, square = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, step: int = STEP,
           shift: int = SHIFT) -> DataFrame:
    """The rows of ``vectors`` that take part, with ``n`` (size of the fit list), ``deviation``
    (squared distance from the mean, times ``n`` squared), ``whitened`` and ``explained`` (one entry
    per component, by falling variance) and ``identity_error``.

    A component ``c`` counts as the integer ``floor(step * c) + shift``. The whitening is fitted on
    each distinct integer vector once, so copies weigh nothing, and applied to all rows. An axis
    has either sign, the same for all rows.

    Rows whose vector is NULL, empty or holds a NULL or non-finite component take no part, nor do
    those of another length than most have (of equally frequent lengths the largest). Repeated
    rows and NULLs in other columns stay; columns of the new names are replaced. A table without
    usable rows gives none. Directions without variance, as with one distinct vector, give no
    component, and the arrays are shorter. Components beyond the range of bigint, and deviations
    beyond it, raise an error.
    """
    v, x = fresh("v"), fresh("x")
    rows = vectors.withColumn(v, as_doubles(vectors[vector])).where(is_finite(F.col(v)))
    new = "n", "deviation", "whitened", "explained", "identity_error"
    kept = [c for c in vectors.columns if c.lower() not in new]
    shape = shape_of(rows, v)
    if shape is None:
        return vectors.limit(0).select(
            *kept, F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("deviation"),
            *[F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")], F.lit(0.0).alias("identity_error"),
        )
    bound = int(shape.largest * step) + abs(shift) + 1
    if bound >= _SAFE:
        raise ValueError("components times step do not fit a bigint")
    d = shape.dimensions
    whole = rows.where(F.size(v) == d).withColumn(x, F.transform(v, lambda c: F.floor(c * step).cast("bigint") + shift))
    # Written, as three passes read it.
    fit_list = settle(whole.select(x).distinct())
    model = fit(fit_list, d, bound, components)
    error = identity_error(fit_list, model)

    def apply(arrays: list[pa.Array]) -> list[pa.Array]:
        y = model.centred(matrix(arrays[0], d))
        whitened = model.whitened(y)
        offsets = pa.array(np.arange(len(y) + 1) * whitened.shape[1], pa.int32())
        return [pa.array(model.deviations(y), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel()))]

    out = add_columns(whole.drop(v), [whole[x]], "deviation bigint, whitened array<double>", apply)
    return out.select(
        *[out[c] for c in kept], F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def per_component(whitened: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row per row and component of ``whiten``'s result; components are numbered from 1."""
    return whitened.select(
        F.col(id_column).alias("vec_id"), "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "one"),
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error"
    )
