"""Whitening of embeddings by a two-pass covariance.

The first pass sums whole-number vectors exactly, which gives the mean as a fraction. The second takes the mean off each vector
before it multiplies: a batch of centred vectors is one matrix product, and the products of tasks are merged in a tree. The
eigenvectors of the covariance, from a symmetric solver on the driver, are broadcast (dims x components numbers), and all rows are
projected. A third pass holds the whitened rows' own covariance against the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches
from ._vectors import finite, matrix

SCALE, OFFSET = 64, 1_000_000
WIDEST = 2.0**62  # whole numbers stop there
DEPTH = 3  # of the trees by which tasks' sums are merged


class Whitening(NamedTuple):
    """n vectors with whole-number sums; values: eigenvalues from the largest; axes: unit eigenvectors as columns; total: the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    total: float


class Sums(NamedTuple):
    """Of some vectors: how many, their mean, and the sum of outer products about it."""

    n: int
    mean: np.ndarray
    products: np.ndarray


def whole(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Each entry c as floor(64 c) + 1000000; missing entries at the end are zeros. Numbers beyond 2**62 stop there."""
    return np.clip(np.floor(SCALE * matrix(column, dims)), -WIDEST, WIDEST).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x less the mean, in doubles, each rounded once or twice; and the same as whole numbers d with a remainder r of n, so that n x - sums = n d - r."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    d = x - base
    return d - rest / n, d, rest


def deviations(d: np.ndarray, rest: np.ndarray, n: int) -> list[Decimal | None]:
    """Sum over dimensions of (n x - sums)^2, exact; None where it has over 38 digits."""
    largest = n * (int(np.abs(d).max(initial=0)) + 1)
    if d.shape[1] * largest**2 < 2**63:
        return [Decimal(v) for v in ((n * d - rest) ** 2).sum(1).tolist()]
    sums = ((n * d.astype(object) - rest.astype(object)) ** 2).sum(1)
    return [Decimal(int(v)) if v < 10**38 else None for v in sums]


def about(y: np.ndarray) -> Sums:
    mean = y.mean(0)
    y = y - mean
    return Sums(len(y), mean, y.T @ y)


def merged(a: Sums | None, b: Sums | None) -> Sums | None:
    """The sums of both parts about their common mean."""
    if a is None or b is None:
        return b if a is None else a
    n, apart = a.n + b.n, b.mean - a.mean
    return Sums(n, a.mean + apart * (b.n / n), a.products + b.products + np.outer(apart, apart) * (a.n * (b.n / n)))


def plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def longest(a: list[int], b: list[int], gap: int) -> list[int]:
    """a, with gap for what b has more."""
    return a + [gap] * (len(b) - len(a))


def added(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """Counts and sums of whole-number vectors together; an entry that vectors lack counts as 0, so as the offset."""
    x, y = longest(a[1], b[1], a[0] * OFFSET), longest(b[1], a[1], b[0] * OFFSET)
    return a[0] + b[0], [i + j for i, j in zip(x, y)]


def gather(rows: DataFrame, of_batch: Callable, merge: Callable, zero):
    """What of_batch gives for batches of v: merged in each task, whose one small result goes on to a tree of merges."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zero
        for batch in it:
            if batch.num_rows:
                own = merge(own, of_batch(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["part"])

    parts = rows.select("v").mapInArrow(work, "part binary").rdd
    return parts.treeAggregate(zero, lambda own, row: merge(own, pickle.loads(row[0])), merge, DEPTH)


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """The eigenvectors of the covariance (divisor n) of all usable rows' whole-number vectors; None without such rows."""
    rows = finite(small_batches(vectors, 4096), vector_col)

    def sums(column: pa.Array) -> tuple[int, list[int]]:
        x = whole(column)
        high, low = x >> 31, x & (2**31 - 1)  # so that no sum of a batch overflows
        return len(x), [(int(h) << 31) + int(v) for h, v in zip(high.sum(0), low.sum(0))]

    n, total = gather(rows, sums, added, (0, []))
    if not n or not total:
        return None

    def products(column: pa.Array) -> np.ndarray:
        y, _, _ = centred(whole(column, len(total)), n, total)
        return y.T @ y

    covariance = gather(rows, products, plus, None) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(values))] < 0, -1, 1)  # the largest entry is positive
    return Whitening(n, total, values, axes, float(np.trace(covariance)))


def scales(model: Whitening, components: int) -> np.ndarray:
    """One over the square roots of the first eigenvalues; NaN where one is zero but for rounding."""
    values = model.values[:components]
    least = len(model.values) * np.finfo(float).eps * float(model.values[0])
    return np.where(values > least, 1 / np.sqrt(np.where(values > least, values, 1)), np.nan)


def identity_error(vectors: DataFrame, model: Whitening, components: int = 32, vector_col: str = "embedding") -> float | None:
    """The largest entry, sign left out, of the whitened rows' covariance less the identity, over components that vary; None if none does."""
    factor = scales(model, components)
    some = ~np.isnan(factor)
    if not some.any():
        return None
    tables = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.axes[:, :components][:, some] * factor[some]))

    def whitened(column: pa.Array) -> Sums:
        n, total, project = tables.value
        return about(centred(whole(column, len(total)), n, total)[0] @ project)

    found = gather(finite(small_batches(vectors, 4096), vector_col), whitened, merged, None)
    return float(np.abs(found.products / found.n - np.eye(int(some.sum()))).max())


def whiten(vectors: DataFrame, model: Whitening | None, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each usable row's whitened components: id_col, component (from 1, by falling eigenvalue), n, deviation, whitened, explained.

    Rows are usable whose vector is there and holds neither nulls nor non-finite entries; others are dropped. Shorter vectors
    have zeros at their end, entries past the model's dimensions are an error. Rows that repeat an id, and null ids, each count.
    deviation (decimal) is null if it has over 38 digits. whitened is null for a component that does not vary. Without a model: no rows.
    """
    rows = finite(small_batches(vectors, 1024), vector_col, F.col(f"`{id_col}`").alias("_id"))
    schema = f"_id {dict(rows.dtypes)['_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    components = min(components, len(model.values))
    explained = model.values[:components] / (model.total or 1)
    tables = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.axes[:, :components] * scales(model, components), explained))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, project, explained = tables.value
        many = len(explained)
        for batch in it:
            y, d, rest = centred(whole(batch.column(0), len(total)), n, total)
            row = np.repeat(np.arange(len(y)), many)
            out = (y @ project).ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(row)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(y))), pa.array(np.full(len(row), n)),
                 pa.array(deviations(d, rest, n), pa.decimal128(38, 0)).take(pa.array(row)), pa.array(out, mask=np.isnan(out)), pa.array(np.tile(explained, len(y)))],
                names=["_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)
