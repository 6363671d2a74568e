"""Polygons of a labelled lattice: cell sides linked into closed rings by pointer doubling, rings put into outer ones and holes.

Cells are dealt to square tiles once, with the cells around. A tile links its own sides and its own parts of patches; rings that close
there are done, and only stretches that leave a tile, and links of cells across, are linked between tiles.

A cell (ix, iy) is the square from there to (ix + 1, iy + 1). Its sides without a neighbour of the same label run
with the cell on their left, so outer rings turn left and have positive area, holes negative. Where two cells of a label
meet in a corner alone, each side goes on along its own cell: patches are of cells that share sides, and holes
that meet in a corner are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.storage import delete, materialize
from .components import connected_components

# of each side: the step to the cell beyond, and its first and last corner from the cell's own
SIDES = [(0, -1, (0, 0), (1, 0)), (1, 0, (1, 0), (1, 1)), (0, 1, (1, 1), (0, 1)), (-1, 0, (0, 1), (0, 0))]
TILE_BITS = 6
TILE, WIDE = 1 << TILE_BITS, (1 << TILE_BITS) + 2  # cells along a tile, and with those around
AT_ONCE = 1 << 17  # rows of whole tiles that a task takes at once
AHEAD = [dy * WIDE + dx for dx, dy, _, _ in SIDES]
NUMBERS = ["side", "next", "least", "area", "length", "root", "a", "b"]


def boundary(cells: DataFrame, label: str, cell: str = "cell") -> DataFrame:
    """side (a number of its own), cell, label, x0, y0, x1, y1 of all sides without a neighbour of the same label. Cells are numbered by whole numbers, each once."""
    side = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("k", "dx", "dy", "x0", "y0", "x1", "y1"), (k, dx, dy, *a, *b)))) for k, (dx, dy, a, b) in enumerate(SIDES))))
    own = cells.select(F.col(cell).cast("long").alias("cell"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(label).alias("label")).filter("label is not null")
    sides = own.select("*", side.alias("s")).select((F.col("cell") * 4 + F.col("s.k")).alias("side"), "cell", "label", (F.col("ix") + F.col("s.dx")).alias("_ix"), (F.col("iy") + F.col("s.dy")).alias("_iy"),
                                                    *((F.col(f"i{c[0]}") + F.col(f"s.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")))
    beyond = own.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "label")
    return sides.join(beyond, ["_ix", "_iy", "label"], "left_anti").select("side", "cell", "label", "x0", "y0", "x1", "y1")


def linked(sides: DataFrame) -> DataFrame:
    """side and next, the side that goes on where it ends: that of its own cell if there are two."""
    ends = sides.select("side", F.col("cell").alias("_cell"), "label", F.col("x1").alias("x0"), F.col("y1").alias("y0"))
    starts = sides.select(F.col("side").alias("_to"), "cell", "label", "x0", "y0")
    return ends.join(starts, ["label", "x0", "y0"]).groupBy("side").agg(F.min_by("_to", F.struct((F.col("cell") != F.col("_cell")).cast("int"), "_to")).alias("next"))


def ring_of(links: DataFrame) -> DataFrame:
    """side and ring, the least side of the ring that it is part of. Each round looks twice as far ahead; none changes once all have met their ring's least."""
    spark = links.sparkSession
    state = materialize(links.select("side", "next", F.least("side", "next").alias("ring")), "rings")
    while True:
        ahead = state.select(F.col("side").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"))
        both = materialize(state.join(ahead, "next").select("side", F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("_moved")), "rings")
        moved = not both.filter("_moved").isEmpty()
        delete(spark, state._table_path)
        state = both
        if not moved:
            return state.select("side", "ring")


def ring_order(links: DataFrame, rings: DataFrame) -> DataFrame:
    """side, ring and seq, its place from the ring's least side on (from 0), by counting the sides up to the ring's end, twice as far each round."""
    spark = links.sparkSession
    first = links.join(rings, "side").select("side", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("n"))
    state = materialize(first, "ring-order")
    while not state.filter("next is not null").isEmpty():
        ahead = state.select(F.col("side").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        both = materialize(state.join(ahead, "next", "left").select("side", "ring", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0).cast("long"))).alias("n")), "ring-order")
        delete(spark, state._table_path)
        state = both
    long = state.filter("side = ring").select("ring", F.col("n").alias("_all"))
    return state.join(long, "ring").select("side", "ring", (F.col("_all") - F.col("n")).alias("seq"))


def _whole_tiles(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    """Rows sorted by tx and ty as tables of whole tiles, of at_once rows and what their last tile has beyond."""
    held, n = [], 0
    for batch in batches:
        if n >= at_once and batch.num_rows:
            place, last = np.stack([batch.column(c).to_numpy() for c in ("tx", "ty")]), [held[-1].column(c)[-1].as_py() for c in ("tx", "ty")]
            other = np.flatnonzero((place != np.array(last)[:, None]).any(0))
            if len(other):
                yield pa.Table.from_batches([*held, batch.slice(0, other[0])])
                batch, held, n = batch.slice(other[0]), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node of its component, by edges a, b: roots hang on lower ones, then all on their root."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while (root != (up := root[root])).any():
            root = up
    return root


def _ends(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node its stretch's end (any node of a closed ring), and the least node from it on, by looking twice as far ahead each round. -1 follows an end."""
    least = np.arange(len(following))
    end = following < 0
    ahead, n = np.where(end, least, following), -1
    while True:
        low, ahead = np.minimum(least, least[ahead]), ahead[ahead]
        before, n = n, np.count_nonzero(end[ahead])
        same, least = n == before and (low == least).all(), low
        if same:
            return ahead, least


def _tile_pieces(t: pa.Table) -> pa.Table:
    """Stretches of rings of the table's tiles, and links of cells (a, b) of one patch across their borders and to their tile's least cell of it."""
    tx, ty, cell, ix, iy = (t[c].to_numpy() for c in ("tx", "ty", "cell", "ix", "iy"))
    codes = t["label"].combine_chunks().dictionary_encode()
    tile = np.cumsum(np.append(0, (np.diff(tx) != 0) | (np.diff(ty) != 0)))
    lx, ly = ix - (tx << TILE_BITS) + 1, iy - (ty << TILE_BITS) + 1
    key = ((tile * len(codes.dictionary) + codes.indices.to_numpy()) * WIDE + ly) * WIDE + lx
    order = np.argsort(key)
    key, cell, ix, lx, ly = (v[order] for v in (key, cell, ix, lx, ly))
    own = (lx >= 1) & (lx <= TILE) & (ly >= 1) & (ly <= TILE)
    mine, n = np.flatnonzero(own), len(key)

    def at(who, step):
        i = np.minimum(np.searchsorted(key, key[who] + step), n - 1)
        return np.where(key[i] == key[who] + step, i, -1)

    beyond = np.full((4, n), -1)
    for k in range(4):
        beyond[k, mine] = at(mine, AHEAD[k])

    # links of cells: within the tile to parts, across its border as rows
    pairs = [(mine[(there := beyond[k, mine]) >= 0], there[there >= 0]) for k in range(4)]
    inner = [(a[own[b]], b[own[b]]) for a, b in pairs[1:3]]
    part = _parts(n, *(np.concatenate(v) for v in zip(*inner)))
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, part[mine], cell[mine])
    root = low[part]
    across = [np.concatenate(v) for v in zip(*((a[~own[b]], b[~own[b]]) for a, b in pairs))]
    up = cell[across[0]] < cell[across[1]]
    border = np.unique(across[0])
    border = border[root[border] != cell[border]]
    link_a, link_b = (np.concatenate((x, y)) for x, y in ((cell[across[0]][up], root[border]), (cell[across[1]][up], cell[border])))

    # sides in the order of their numbers, and the one that goes on where each ends: on the own cell, straight on, or on the cell across the corner
    who, to = [], []
    for k in range(4):
        w = mine[beyond[k, mine] < 0]
        ahead, corner = beyond[(k + 1) % 4, w], at(w, AHEAD[k] + AHEAD[(k + 1) % 4])
        who.append(w * 4 + k)
        to.append(np.where(ahead < 0, w * 4 + (k + 1) % 4, np.where(corner < 0, ahead * 4 + k, corner * 4 + (k + 3) % 4)))
    who, to = np.concatenate(who), np.concatenate(to)
    number = lambda s: cell[s // 4] * 4 + s % 4
    by = np.argsort(number(who))
    who, to = who[by], to[by]
    place = np.full(4 * n, -1)
    place[who] = np.arange(len(who))
    following = place[to]
    end, least = _ends(following)
    leaves = following[end] < 0
    stretch = np.where(leaves, end, least)
    k = who % 4
    area, length = np.zeros(len(who), np.int64), np.bincount(stretch, minlength=len(who))
    np.add.at(area, stretch, np.where(k == 1, ix[who // 4] + 1, 0) - np.where(k == 3, ix[who // 4], 0))
    first = np.ones(len(who), bool)
    first[following[following >= 0]] = False
    first = np.flatnonzero(first | (stretch == np.arange(len(who))) & ~leaves)
    on, m, q = stretch[first], len(link_a), len(first)
    whole = np.zeros(q, bool)
    numbers = [(number(who[first]), whole), (number(to[on]), ~leaves[first]), (number(who[least[first]]), whole), (area[on], whole), (length[on], whole), (root[who[first] // 4], whole)]
    columns = [pa.concat_arrays([pa.array(v, pa.int64(), mask=none), pa.nulls(m, pa.int64())]) for v, none in numbers] + [pa.concat_arrays([pa.nulls(q, pa.int64()), pa.array(v, pa.int64())]) for v in (link_a, link_b)]
    label = t["label"].combine_chunks().take(pa.array(order[who[first] // 4]))
    return pa.table([*columns, pa.concat_arrays([label, pa.nulls(m, label.type)])], names=[*NUMBERS, "label"])


def pieces(cells: DataFrame, label: str, cell: str = "cell", at_once: int = AT_ONCE) -> DataFrame:
    """What tiles tell alone, after one shuffle of the cells (and of those at borders, once for each tile that they touch).

    Rows with `side` are stretches of rings: their first side, `next` that goes on in another tile (null for a closed ring), least side,
    area to the axis, length, label and root (the least cell of the tile's part of the patch). Rows with a and b link cells of one patch across borders.
    """
    own = cells.select(F.col(cell).cast("long").alias("cell"), F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(label).alias("label")).filter("label is not null")
    tiles = lambda c: F.explode(F.sequence(F.shiftright(F.col(c) - 1, TILE_BITS), F.shiftright(F.col(c) + 1, TILE_BITS)))
    dealt = own.select("*", tiles("ix").alias("tx")).select("*", tiles("iy").alias("ty")).repartition("tx", "ty").sortWithinPartitions("tx", "ty")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches, at_once):
            yield from _tile_pieces(t).to_batches()

    return dealt.mapInArrow(work, StructType([*(StructField(c, LongType()) for c in NUMBERS), StructField("label", own.schema["label"].dataType)]))


def rings(cells: DataFrame, label: str, cell: str = "cell") -> DataFrame:
    """One row for each ring: label, polygon (the least cell of its patch), ring, is_hole, area (negative for holes), length. An empty lattice has none; cells without a label have no part in any."""
    found = materialize(pieces(cells, label, cell), "pieces")
    closed = found.filter("side is not null and next is null").select("label", "root", F.col("least").alias("ring"), "area", "length")
    parted = found.filter("next is not null")
    joined = parted.join(ring_of(parted.select("side", "next")), "side").groupBy("ring")
    joined = joined.agg(F.first("label").alias("label"), F.first("root").alias("root"), F.min("least").alias("_least"), F.sum("area").alias("area"), F.sum("length").alias("length"))
    every = closed.unionByName(joined.select("label", "root", F.col("_least").alias("ring"), "area", "length"))
    of = connected_components(found.filter("a is not null").select("a", "b")).withColumnsRenamed({"node": "root", "component": "polygon"})
    area = F.col("area").cast("double")
    return every.join(of, "root", "left").select("label", F.coalesce("polygon", "root").alias("polygon"), "ring", (area < 0).alias("is_hole"), area.alias("area"), "length")


def polygons(cells: DataFrame, label: str, cell: str = "cell", least_area: float = 0.0) -> DataFrame:
    """One row for each patch of cells of a label that share sides: label, polygon, area (in cells), length (of all its rings), n_holes; those of less than least_area are left out."""
    out = rings(cells, label, cell).groupBy("label", "polygon").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if("is_hole").alias("n_holes"))
    return out.filter(F.col("area") >= least_area)


def vertices(cells: DataFrame, label: str, cell: str = "cell") -> DataFrame:
    """Corners of all rings in order, those on straight stretches left out: label, ring, seq, x, y. A ring's first side starts its order; rings are closed, so the first corner is not repeated."""
    sides = materialize(boundary(cells, label, cell), "sides")
    links = materialize(linked(sides), "links")
    order = ring_order(links, ring_of(links))
    straight = sides.select(F.col("side").alias("next"), F.col("x1").alias("_x"), F.col("y1").alias("_y"))
    corner = links.join(straight, "next").join(sides, "side").withColumn("_turns", (F.col("x1") - F.col("x0")) * (F.col("_y") - F.col("y1")) != (F.col("y1") - F.col("y0")) * (F.col("_x") - F.col("x1")))
    return corner.filter("_turns").join(order, "side").select("label", "ring", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
