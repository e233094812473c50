"""Whitening of embeddings on their leading principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm.feast import leading_eigenpairs
from verdure.session import materialize

_EXACT = 1 << 62  # integers below this stay in 64 bits


@dataclass(frozen=True)
class Whitening:
    """What was fitted. All parts have the size of a vector or of a component, whatever the number of rows.

    ``n`` distinct quantised vectors with the exact ``sums`` per dimension; ``components`` holds unit eigenvectors as
    columns, ``eigenvalues`` falls, ``trace`` is the total variance. ``usable`` marks components whose variance
    is above rounding noise. ``identity_error`` is the largest absolute entry of the covariance of the usable
    whitened components minus the identity, or None without any.
    """

    n: int
    dimension: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    usable: np.ndarray
    identity_error: float | None

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.eigenvalues]

    def projection(self) -> np.ndarray:
        """Columns that turn centred vectors into whitened components; a component without variance gives NaN."""
        scale = np.full(len(self.eigenvalues), np.nan)
        scale[self.usable] = 1 / np.sqrt(self.eigenvalues[self.usable])
        return self.components * scale


def quantised(rows: DataFrame, key: str, column: str, step: int = 256) -> DataFrame:
    """``key, x``: the rows with a usable vector, each entry as ``floor(step * entry)`` in 64 bits.

    A vector is not usable if it is null, empty or holds a null, NaN or infinite entry.
    """
    vector = F.col(column)
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(vector, lambda e: F.floor(F.lit(step) * e.cast("double")).cast("long"))
    usable = rows.where(vector.isNotNull() & (F.size(vector) > 0) & finite)
    return usable.select(F.col(key).alias("key"), whole.alias("x"))


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Fits ``components`` leading components on the distinct vectors ``x`` of ``vectors``; None without any vector.

    Only vectors of the commonest length count, of equally common ones the longest. Covariances have the divisor n
    and are centred before multiplying. Every partition hands on sums of the size of the matrix, which Spark adds
    up; the driver sees one number per pair of dimensions.
    """
    distinct = materialize(vectors.select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    dimension, n = lengths["size"], lengths["count"]
    fit = distinct.where(F.size("x") == dimension)
    sums = _sums(fit, dimension)
    covariance = _products(fit, dimension, dimension, lambda x: _centred(x, n, sums)) / n
    values, vectors_ = leading_eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    usable = values > dimension * np.finfo(np.float64).eps * trace
    model = Whitening(n, dimension, tuple(sums), values, vectors_, trace, usable, None)
    if not usable.any():
        return model
    projection = model.projection()[:, usable]
    whitened = _products(fit, dimension, projection.shape[1], lambda x: _centred(x, n, sums) @ projection) / n
    error = float(np.abs(whitened - np.eye(len(whitened))).max())
    return Whitening(n, dimension, tuple(sums), values, vectors_, trace, usable, error)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``key, deviation, whitened`` for every row of ``vectors(key, x)`` of the model's dimension.

    ``deviation`` is the exact sum over the dimensions of ``(n * x - sum) ** 2``, or null where that does not fit
    64 bits. ``whitened`` has an entry per component, null for a component without variance. Rows with equal or null
    keys are kept; rows of another dimension are left out.
    """
    n, sums, projection, dimension = model.n, model.sums, model.projection(), model.dimension
    wide = projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dimension)
            flat = (_centred(x, n, sums) @ projection).ravel()
            entries = pa.array(flat, pa.float64(), mask=np.isnan(flat))
            ends = pa.array(np.arange(0, len(flat) + 1, wide), pa.int32())
            deviation = pa.array(_deviation(x, n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), deviation, pa.ListArray.from_arrays(ends, entries)], ["key", "deviation", "whitened"]
            )

    kind = vectors.schema["key"].dataType.simpleString()
    fitting = vectors.where(F.size("x") == dimension)
    return fitting.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>")


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _difference(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums``, exactly: in 64 bits where it fits, else in Python's integers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums))
    if largest < _EXACT:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _difference(x, n, sums).astype(np.float64) / n


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    away = _difference(x, n, sums)
    largest = max(int(away.max(initial=0)), -int(away.min(initial=0)))
    if away.dtype != object and largest * largest * len(sums) >= _EXACT:
        away = away.astype(object)
    total = (away * away).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in total.tolist()]


def _sums(fit: DataFrame, dimension: int) -> tuple[int, ...]:
    """The exact sum of every dimension."""

    def run(batches):
        total = np.zeros(dimension, object)
        for batch in batches:
            x = _matrix(batch, dimension)
            largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
            small = largest * max(1, len(x)) < _EXACT
            total += (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimension), pa.int32()), pa.array([str(t) for t in total])], ["i", "total"]
        )

    parts = fit.mapInArrow(run, "i int, total string")
    added = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i")
    return tuple(int(r["total"]) for r in added.collect())


def _products(fit: DataFrame, dimension: int, side: int, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of the outer products of all transformed rows."""
    def run(batches):
        total = np.zeros((side, side))
        for batch in batches:
            z = transform(_matrix(batch, dimension))
            total += z.T @ z
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, side * side + 1, side), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(side), pa.int32()), rows], ["i", "row"])

    parts = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    added = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((side, side))
    for i, j, value in added:
        out[i, j] = value
    return out
