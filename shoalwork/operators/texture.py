"""Neighbourhood operators: co-occurrence texture on tiles with a halo, distance to a class by tiles that send one another their frontiers.

Pixels are dealt to square tiles; a pixel near an edge goes to its neighbours' tiles too, so each tile is worked on
alone and no task sees more than a tile and what it is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """Pixels (row, col, ...) by tile (tr, tc), and whether they are the tile's own."""
    if halo >= tile:
        raise ValueError("the halo must be smaller than a tile")
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile) for d in (-halo, 0, halo))))
    out = pixels.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    return out.withColumn("own", (F.floor(F.col("row") / tile) == F.col("tr")) & (F.floor(F.col("col") / tile) == F.col("tc")))


STEPS = ((0, 1), (1, 0), (1, 1), (1, -1))  # neighbours to the right, below and on both diagonals


def cooccurrence(levels_grid: np.ndarray, width: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse difference moment, entropy and contrast of the window about every pixel of a grid of levels (-1: no value).

    Pairs of neighbours are numbered by their two levels, whichever comes first. All windows at once: a window's pairs are sorted, and the
    lengths of their runs are the matrix' entries. NaN for windows without a pair.
    """
    r, (h, w) = width // 2, levels_grid.shape
    g = np.full((h + 2 * r, w + 2 * r), -1, np.int32)
    g[r : r + h, r : r + w] = levels_grid
    parts = []
    for dr, dc in STEPS:
        a, b = g[: g.shape[0] - dr, max(0, -dc) : g.shape[1] - max(0, dc)], g[dr:, max(0, dc) : g.shape[1] + min(0, dc)]
        code = np.where((a >= 0) & (b >= 0), np.minimum(a, b) * levels + np.maximum(a, b), -1)
        parts.append(np.lib.stride_tricks.sliding_window_view(code, (width - dr, width - abs(dc))).reshape(h, w, -1))
    code = np.sort(np.concatenate(parts, 2).reshape(h * w, -1), 1)
    ok, d = code >= 0, (code % levels - code // levels) ** 2
    n = ok.sum(1)
    some = np.maximum(n, 1)
    idm, contrast = (ok / (1 + d)).sum(1) / some, (ok * d).sum(1) / some
    first = np.ones(code.shape, bool)
    first[:, 1:] = code[:, 1:] != code[:, :-1]
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, code.size))
    row, own = at // code.shape[1], code.ravel()[at]
    share = np.where(own >= 0, runs / some[row], 0.0)
    # a pair of two levels stands in the matrix twice, with half its share each
    each = np.where(own // levels == own % levels, share, share / 2)
    entropy = np.bincount(row, -share * np.log(np.where(each > 0, each, 1.0)), h * w)
    return tuple(np.where(n > 0, v, np.nan).reshape(h, w) for v in (idm, entropy, contrast))


def texture(pixels: DataFrame, value: str, low: float, high: float, width: int = 5, levels: int = 32, tile: int = 64) -> DataFrame:
    """row, col, idm, entropy and contrast of the window of `width` pixels about each pixel; values are cut into levels. Nulls where no two neighbours have a value."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf.row.min(), pdf.col.min()
        grid = np.full((pdf.row.max() - r0 + 1, pdf.col.max() - c0 + 1), -1, np.int32)
        ok = pdf[value].notna()
        grid[pdf.row[ok] - r0, pdf.col[ok] - c0] = np.clip(((pdf[value][ok] - low) / (high - low) * levels).astype(int), 0, levels - 1)
        own = pdf[pdf.own]
        at = (own.row.to_numpy() - r0, own.col.to_numpy() - c0)
        return pd.DataFrame({"row": own.row.to_numpy(), "col": own.col.to_numpy(), **{n: v[at] for n, v in zip(("idm", "entropy", "contrast"), cooccurrence(grid, width, levels))}})

    out = with_halo(pixels.select("row", "col", value), tile, width // 2).groupBy("tr", "tc").applyInPandas(work, "row long, col long, idm double, entropy double, contrast double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("idm", "entropy", "contrast")})


def nearest_points(at: tuple[np.ndarray, np.ndarray], points: tuple[np.ndarray, np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Squared distance from each place (rows, cols) to the nearest of the points: in every column of points the nearest above or below
    each row, then the least over columns. most: numbers held at a time."""
    rows, row = np.unique(at[0], return_inverse=True)
    cols, of = np.unique(points[1], return_inverse=True)
    base = min(rows.min(), points[0].min())
    span = int(max(rows.max(), points[0].max()) - base + 1)
    keys = np.unique(of * span + (points[0] - base))  # by column, then row
    asked = np.arange(len(cols))[None, :] * span + (rows - base)[:, None]
    place = np.searchsorted(keys, asked)
    gap = np.full(asked.shape, np.inf)
    for k in (place, place - 1):
        k = np.clip(k, 0, len(keys) - 1)
        own = keys[k] // span == np.arange(len(cols))
        gap = np.where(own, np.minimum(gap, np.abs(keys[k] - asked)), gap)
    out, step = np.empty(len(row)), max(1, most // len(cols))
    for i in range(0, len(row), step):
        part = slice(i, i + step)
        out[part] = (gap[row[part]] ** 2 + (at[1][part, None] - cols[None, :]) ** 2).min(1)
    return out


def _reach(tiles: DataFrame) -> DataFrame:
    """tr, tc and reach of every tile: in how many steps between tiles one with a target is surely met. Blocks of tiles twice as wide are looked through in each
    round for the tiles that the rounds before left; rows (with _hit, whether the tile has a target) without any target anywhere have none."""
    spark, wide = tiles.sparkSession, 1
    pending, done, written = tiles.select("tr", "tc"), None, []
    hits = tiles.filter("_hit").select("tr", "tc")
    if hits.isEmpty():
        return tiles.select("tr", "tc", F.lit(0).alias("reach")).limit(0)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    while True:
        block = lambda c, w=wide: F.floor(F.col(c) / w)
        near = hits.select(block("tr").alias("_r"), block("tc").alias("_c")).distinct().select(around.alias("_s"), "_r", "_c").select((F.col("_r") + F.col("_s.a")).alias("_r"), (F.col("_c") + F.col("_s.b")).alias("_c")).distinct()
        found = pending.withColumns({"_r": block("tr"), "_c": block("tc")}).join(near.withColumn("_near", F.lit(True)), ["_r", "_c"], "left")
        found = materialize(found.select("tr", "tc", F.coalesce("_near", F.lit(False)).alias("_near")), "tiles")
        written.append(found)
        here = found.filter("_near").select("tr", "tc", F.lit(2 * wide - 1).alias("reach"))
        done = here if done is None else done.unionByName(here)
        pending = found.filter("not _near").select("tr", "tc")
        if pending.isEmpty():
            break
        wide *= 2
    out = materialize(done, "tiles")
    for t in written:
        delete(spark, t._table_path)
    return out


def distance_to_class(pixels: DataFrame, code: str, target: int, tile: int = 128) -> DataFrame:
    """Exact distance in pixels to the nearest pixel of the target class, however far; null if there is none.

    Pixels are worked on tile by tile. What of a tile can be nearest to a pixel outside is its frontier on that side: of each row the first or last
    target, or of each column the topmost or lowest, so a tile has at most as many as it is wide for each side. Every tile first learns how far a tile with a target is at most,
    then is sent the frontiers of the tiles that can hold a nearer one than all others must; joins are on tiles' places. A task holds one tile with those frontiers.
    Only pixels that are there count as places; rows without a place are passed over.
    """
    place = {"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)}
    own = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce(F.col(code) == target, F.lit(False)).alias("_hit")).filter("row is not null and col is not null")
    own = own.withColumns(place)
    tiles = own.groupBy("tr", "tc").agg(F.max("_hit").alias("_hit"))
    hits = own.filter("_hit")
    point = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    by_row = hits.groupBy("tr", "tc", "row").agg(F.min("col").alias("_a"), F.max("col").alias("_z")).groupBy("tr", "tc").agg(F.collect_list(point("row", "_a")).alias("left"), F.collect_list(point("row", "_z")).alias("right"))
    by_col = hits.groupBy("tr", "tc", "col").agg(F.min("row").alias("_a"), F.max("row").alias("_z")).groupBy("tr", "tc").agg(F.collect_list(point("_a", "col")).alias("top"), F.collect_list(point("_z", "col")).alias("bottom"))
    reach = _reach(tiles)
    # no target is farther than sqrt(2) * (reach + 1) tiles, so none nearer is over most steps away
    most = F.floor(F.lit(2.0**0.5) * (F.col("reach") + 1) + 1).cast("int")
    step = lambda n: F.explode(F.sequence(-n, n))
    pairs = reach.withColumn("_dr", step(most)).withColumn("_dc", step(most)).select(F.col("tr").alias("_r"), F.col("tc").alias("_c"), (F.col("tr") + F.col("_dr")).alias("tr"), (F.col("tc") + F.col("_dc")).alias("tc"), "_dr", "_dc").join(tiles.filter("_hit").select("tr", "tc"), ["tr", "tc"])
    far = F.pow(F.abs("_dr") + 1, 2) + F.pow(F.abs("_dc") + 1, 2)
    near = F.pow(F.greatest(F.abs("_dr") - 1, F.lit(0)), 2) + F.pow(F.greatest(F.abs("_dc") - 1, F.lit(0)), 2)
    bound = pairs.groupBy("_r", "_c").agg(F.min(far).alias("_far"))
    pairs = pairs.join(bound, ["_r", "_c"]).filter((near <= F.col("_far")) & ((F.col("_dr") != 0) | (F.col("_dc") != 0)))
    side = F.when(F.col("_dr") > 0, F.col("top")).when(F.col("_dr") < 0, F.col("bottom")).when(F.col("_dc") > 0, F.col("left")).otherwise(F.col("right"))
    sent = pairs.join(by_row, ["tr", "tc"]).join(by_col, ["tr", "tc"]).select(F.col("_r").alias("tr"), F.col("_c").alias("tc"), side.alias("points"))

    def work(key, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        own = mine[mine._hit]
        rows, cols = [own.row.to_numpy(np.int64)], [own.col.to_numpy(np.int64)]
        for points in others.points:
            rows.append(np.array([p["r"] for p in points], np.int64))
            cols.append(np.array([p["c"] for p in points], np.int64))
        points, at = (np.concatenate(rows), np.concatenate(cols)), (mine.row.to_numpy(np.int64), mine.col.to_numpy(np.int64))
        best = np.sqrt(nearest_points(at, points)) if len(points[0]) and len(mine) else np.full(len(mine), np.nan)
        return pd.DataFrame({"row": mine.row, "col": mine.col, "distance": best})

    out = own.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInPandas(work, "row long, col long, distance double")
    return out.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
