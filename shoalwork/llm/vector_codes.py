"""Compression of vectors to codes of a few bytes: a codebook for each part of the vector, fitted in rounds.

A vector is cut into equal parts, each of which is replaced by the index of its codebook's nearest entry. In each round
every codebook goes to the tasks as a kd-tree. A batch of parts first goes down to the leaf on its side of every cut, which
gives each a distance to beat, then visits the tree's other nodes by branch and bound: a node is entered only by
parts whose distance to its box is not above their best. Boxes at just that distance are entered too, so that of equal
distances the lower index is found. Sums of the parts by entry, whole numbers, are added up within tasks and then by
Spark, and make the next round's entries. Only codebooks (parts x entries x dims / parts numbers) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release, small_batches
from ._vectors import finite, matrix

SCALE, LEAF = 1024, 8


class Tree(NamedTuple):
    """A node's box and either its entries (their indexes, ascending) or the dimension and value that it is cut at, with children for up to and above it."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    indexes: np.ndarray
    dim: int
    cut: float
    below: Tree | None
    above: Tree | None


def whole(values: np.ndarray) -> np.ndarray:
    """Floors of 1024 times the values, as longs, or as Python's integers where one is beyond 2**62."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values)
    if np.abs(x).max(initial=0) < 2.0**62:
        return x.astype(np.int64)
    if not np.isfinite(x).all():  # 1024 times the largest doubles
        return np.array([int(v) * SCALE if abs(v) > 2.0**60 else int(np.floor(SCALE * v)) for v in values.ravel().tolist()], object).reshape(values.shape)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(values.shape)


def exact(x: np.ndarray, reach: int, dims: int) -> np.ndarray:
    """x in the fastest type in which squared distances are exact, of vectors of so many numbers up to reach."""
    most = dims * (2 * reach) ** 2
    return x.astype(np.float64 if most < 2**53 else np.int64 if most < 2**62 else object)


def magnitude(x: np.ndarray) -> int:
    return max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0


def build(entries: np.ndarray, indexes: np.ndarray | None = None) -> Tree:
    """A kd-tree of the rows of entries: nodes are cut at the median of their widest dimension; entries that are all alike stay together."""
    indexes = np.arange(len(entries)) if indexes is None else indexes
    own = entries[indexes]
    low, high = own.min(0), own.max(0)
    dim = int(np.argmax(high - low)) if own.shape[1] else 0
    if len(indexes) <= LEAF or not own.shape[1] or low[dim] == high[dim]:
        return Tree(low, high, own, indexes, -1, 0, None, None)
    ranked = np.sort(own[:, dim])
    cut = ranked[(len(ranked) - 1) // 2]
    if cut == high[dim]:
        cut = ranked[np.searchsorted(ranked, cut) - 1]  # the next lower value
    under = own[:, dim] <= cut
    return Tree(low, high, own[:0], indexes[:0], dim, cut, build(entries, indexes[under]), build(entries, indexes[~under]))


def nearest(tree: Tree, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (of equally near ones the lowest) and the squared distance; rows and entries of one exact type."""
    n = len(parts)
    best, index = np.zeros(n, parts.dtype), np.full(n, 2**62)
    home: list[tuple[Tree, np.ndarray]] = [(tree, np.arange(n))]

    def compare(node: Tree, rows: np.ndarray) -> None:
        x, before, at = parts[rows], best[rows], index[rows]
        for entry, k in zip(node.entries, node.indexes):
            apart = x - entry
            d = (apart * apart).sum(1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)
            nearer = (at == 2**62) | (d < before) | (d == before) & (k < at)
            before, at = np.where(nearer, d, before), np.where(nearer, k, at)
        best[rows], index[rows] = before, at

    homes = np.full(n, -1)
    number = 0
    while home:  # every row to the leaf on its side
        node, rows = home.pop()
        if node.below is None:
            if len(rows):
                compare(node, rows)
                homes[rows] = number
            number += 1
            continue
        under = parts[rows, node.dim] <= node.cut
        home += [(node.above, rows[~under]), (node.below, rows[under])]
    todo, number = [(tree, np.arange(n))], 0
    while todo:  # the leaves come in the order of before
        node, rows = todo.pop()
        if len(rows):
            x = parts[rows]
            apart = np.maximum(np.maximum(node.low - x, x - node.high), 0)
            bound = (apart * apart).sum(1) if apart.dtype == object else np.einsum("ij,ij->i", apart, apart)
            rows = rows[bound <= best[rows]]
        if node.below is None:
            rows = rows[homes[rows] != number]
            if len(rows):
                compare(node, rows)
            number += 1
            continue
        todo += [(node.above, rows), (node.below, rows)]
    return index, best


class Codebooks(NamedTuple):
    """entries: parts x entries x (dims / parts) whole numbers."""

    dims: int
    entries: np.ndarray

    def sha256(self) -> str:
        """Of all numbers by part, entry and place, as decimals between commas."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel().tolist()).encode()).hexdigest()


def cut(x: np.ndarray, books: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Parts of the rows and codebooks, in one exact type."""
    reach = max(magnitude(x), magnitude(books))
    parts, width = len(books), books.shape[2]
    return [exact(x[:, p * width : (p + 1) * width], reach, x.shape[1]) for p in range(parts)], [exact(b, reach, x.shape[1]) for b in books]


def _assigner(books: np.ndarray):
    """A function from rows to (index, squared distance) by part; trees are built once for each type of number."""
    trees: dict = {}

    def assign(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts, exactly = cut(x, books)
        kind = parts[0].dtype
        if kind not in trees:
            trees[kind] = [build(b) for b in exactly]
        return [nearest(tree, part) for tree, part in zip(trees[kind], parts)]

    return assign


def decimals(x: np.ndarray) -> pa.Array:
    return pa.array(x).cast(pa.decimal128(38, 0)) if x.dtype != object else pa.array([Decimal(int(v)) if abs(v) < 10**38 else None for v in x], pa.decimal128(38, 0))


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Codebooks from the vectors of the least ids (null ids last, equal ids by vector)."""
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None
    dims = -(-dims // parts) * parts
    least = rows.orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).collect()  # as many rows as a codebook has
    x = whole(np.array([[*r.v, *[0.0] * (dims - len(r.v))] for r in least]))
    return Codebooks(dims, np.stack(np.split(x, parts, 1)))


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks fitted to all usable vectors; None without such vectors.

    Each starts as that part of the vectors of the least ids. In every round parts go to their nearest entry and each entry
    becomes the floor of its parts' mean, component by component; entries that no part went to stay.
    """
    rows = finite(small_batches(vectors, 4096), vector_col, F.col(f"`{id_col}`").alias("_id"))
    model = first_books(rows, parts, entries)
    for _ in range(rounds if model else 0):
        model = Codebooks(model.dims, _refined(rows, model))
    return model


def _refined(rows: DataFrame, model: Codebooks) -> np.ndarray:
    """The entries after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    parts, entries, width = model.entries.shape

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, books = shared.value
        assign = _assigner(books)
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in it:
            x = whole(matrix(batch.column(0), dims))
            fits = x.dtype != object and len(x) * (magnitude(x) + 1) < 2**62
            for p, (index, _) in enumerate(assign(x) if len(x) else []):
                order = np.argsort(index, kind="stable")
                met, first = np.unique(index[order], return_index=True)
                part = x[order, p * width : (p + 1) * width]
                total[p, met] += np.add.reduceat(part if fits else part.astype(object), first, axis=0)
                count[p] += np.bincount(index, minlength=entries)
        p, k = np.nonzero(count)
        slot, place = np.repeat(p * entries + k, width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), decimals(total[p, k].ravel()), pa.array(np.repeat(count[p, k], width))], names=["slot", "place", "total", "n"])

    added = rows.select("v").mapInArrow(sums, "slot long, place long, total decimal(38,0), n long").groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    books = model.entries.astype(object)
    for r in added.collect():  # a row for each number of the codebooks
        books[r.slot // entries, r.slot % entries, r.place] = int(r.total) // r.n
    shared.unpersist()
    return books.astype(np.int64) if magnitude(books) < 2**62 else books


def encode(vectors: DataFrame, model: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Each usable row's id_col, code (two hex digits a part; four where codebooks have over 256 entries), error (squared
    distances over parts), label_error (error summed over equal labels, nulls together) and codebooks_sha256; errors are decimals.

    Rows are usable whose vector is there and holds neither nulls nor non-finite entries. Shorter vectors have zeros at their end, as have all
    where parts do not divide their length; vectors longer than the codebooks' are an error. Rows that repeat an id, and null ids, each get a row. Without a model: no rows.
    """
    rows = finite(small_batches(vectors, 4096), vector_col, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"))
    types = dict(rows.dtypes)
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"_id {types['_id']}, code string, error decimal(38,0), label_error decimal(38,0), codebooks_sha256 string").withColumnRenamed("_id", id_col)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    digits = 2 if model.entries.shape[1] <= 256 else 4

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, books = shared.value
        assign = _assigner(books)
        for batch in it:
            found = assign(whole(matrix(batch.column(0), dims)))
            error = found[0][1].astype(np.int64) if found[0][1].dtype != object else found[0][1]
            for _, d in found[1:]:
                error = error + (d.astype(np.int64) if d.dtype != object else d)
            codes = np.stack([index for index, _ in found], 1)
            code = [row.tobytes().hex() for row in codes.astype(">u1" if digits == 2 else ">u2")]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(code, pa.string()), decimals(error)], names=["_id", "_label", "code", "error"])

    coded = materialize(rows.mapInArrow(work, f"_id {types['_id']}, _label {types['_label']}, code string, error decimal(38,0)"), "codes")
    sums = materialize(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("_label", "_of")
    both = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))  # Spark broadcasts the sums if they are few
    return both.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
