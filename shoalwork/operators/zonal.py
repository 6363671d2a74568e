"""Lattices of square cells: building, neighbours, patches and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cell_of
from ..plans.storage import materialize, release
from .components import connected_components

ROOK = [(0, 1), (1, 0), (0, -1), (-1, 0)]
QUEEN = ROOK + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def grid(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """Square cells that cover a box snapped outwards: cell, ix, iy, x and y of the centre; numbered by x, then y."""
    lo_x, lo_y = int(x0 // size), int(y0 // size)
    n_x, n_y = int(-(-x1 // size)) - lo_x, int(-(-y1 // size)) - lo_y
    rows = spark.range(n_x * n_y).select(F.col("id").alias("cell"), (F.floor(F.col("id") / n_y) + lo_x).alias("ix"), (F.pmod("id", F.lit(n_y)) + lo_y).alias("iy"))
    return rows.select("*", ((F.col("ix") + 0.5) * size).alias("x"), ((F.col("iy") + 0.5) * size).alias("y"))


def neighbours(cells: DataFrame, cell: str = "cell", contiguity: str = "queen") -> DataFrame:
    """Edges (cell, neighbor) on the integer lattice (ix, iy), by equi-join on shifted places."""
    steps = QUEEN if contiguity == "queen" else ROOK
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps)))
    moved = cells.select(F.col(cell).alias("_c"), "ix", "iy", shift.alias("_s")).select("_c", (F.col("ix") + F.col("_s.dx")).alias("ix"), (F.col("iy") + F.col("_s.dy")).alias("iy"))
    return moved.join(cells.select("ix", "iy", F.col(cell).alias("neighbor")), ["ix", "iy"]).select(F.col("_c").alias(cell), "neighbor")


def neighbour_lag(panel: DataFrame, edges: DataFrame, value: str, cell: str = "cell", month: str = "month", months: int = 1) -> DataFrame:
    """Mean of the neighbours' values of so many months before."""
    around = edges.join(panel.select(F.col(cell).alias("neighbor"), month, value), "neighbor").groupBy(cell, month).agg(F.avg(value).alias("_around"))
    earlier = around.select(cell, F.add_months(month, months).alias(month), F.col("_around").alias(f"{value}_around_lag{months}"))
    return panel.join(earlier, [cell, month], "left")


def patches(cells: DataFrame, label: str, cell: str = "cell", contiguity: str = "queen") -> DataFrame:
    """Each cell's patch: the least cell of those of its label that touch one another."""
    steps = [s for s in (QUEEN if contiguity == "queen" else ROOK) if s > (0, 0)]  # each pair once
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps)))
    own = cells.select(F.col(cell).alias("a"), "ix", "iy", F.col(label).alias("_l"))
    moved = own.select("a", "_l", "ix", "iy", shift.alias("_s")).select("a", "_l", (F.col("ix") + F.col("_s.dx")).alias("ix"), (F.col("iy") + F.col("_s.dy")).alias("iy"))
    found = connected_components(moved.join(own.withColumnRenamed("a", "b"), ["ix", "iy", "_l"]).select("a", "b"))
    return cells.join(found.withColumnsRenamed({"node": cell, "component": "patch"}), cell, "left").withColumn("patch", F.coalesce("patch", cell))


def drop_small_patches(cells: DataFrame, label: str, target: int, replacement: int, least: int, cell: str = "cell", contiguity: str = "queen") -> DataFrame:
    """Patches of the target under `least` cells get the replacement label."""
    p = patches(cells, label, cell, contiguity)
    small = (F.count("*").over(Window.partitionBy("patch")) < least) & (F.col(label) == target)
    return p.withColumn("cleaned", F.when(small, replacement).otherwise(F.col(label)))


def patch_table(cells: DataFrame, label: str, target: int, least: int = 1, cell: str = "cell") -> DataFrame:
    """Patches of the target with their size and bounds."""
    return patches(cells.filter(F.col(label) == target), label, cell).groupBy("patch").agg(F.count("*").alias("n_cells"), F.min("ix").alias("min_ix"), F.max("ix").alias("max_ix"), F.min("iy").alias("min_iy"), F.max("iy").alias("max_iy")).filter(F.col("n_cells") >= least)


def adjacency(cells: DataFrame, part: str, cell: str = "cell") -> DataFrame:
    """Pairs of parts that share an edge."""
    e = neighbours(cells, cell, "rook")
    p = cells.select(F.col(cell).alias("_k"), F.col(part).alias("_p"))
    pairs = e.join(p, e[cell] == p["_k"]).withColumnRenamed("_p", "_a").drop("_k").join(p, F.col("neighbor") == F.col("_k")).filter("_a < _p")
    return pairs.groupBy(F.col("_a").alias("a"), F.col("_p").alias("b")).agg(F.count("*").alias("n_edges"))


def outline(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Sides of cells without a neighbour: cell and the step that leads out."""
    shift = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ROOK)))
    sides = cells.select(cell, "ix", "iy", shift.alias("_s")).select(cell, "_s.dx", "_s.dy", (F.col("ix") + F.col("_s.dx")).alias("ix"), (F.col("iy") + F.col("_s.dy")).alias("iy"))
    return sides.join(cells.select("ix", "iy"), ["ix", "iy"], "left_anti").select(cell, "dx", "dy")


def focal_median(pixels: DataFrame, value: str, radius: int = 2) -> DataFrame:
    """Median of the square neighbourhood of each pixel (row, col), by sending values to the places around."""
    offs = F.sequence(F.lit(-radius), F.lit(radius))
    sent = pixels.select("row", "col", value).withColumn("_dr", F.explode(offs)).withColumn("_dc", F.explode(offs)).select((F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"), value)
    return pixels.select("row", "col").join(sent, ["row", "col"]).groupBy("row", "col").agg(F.median(value).alias(f"{value}_focal"))


def moran(values: DataFrame, edges: DataFrame, value: str, cell: str = "cell") -> DataFrame:
    """Moran's I under equal weights of the edges."""
    mean = values.agg(F.avg(value).alias("_m"))
    d = values.join(F.broadcast(mean)).select(F.col(cell).alias("_k"), (F.col(value) - F.col("_m")).alias("_d"))
    total = d.agg(F.sum(F.col("_d") * F.col("_d")).alias("_ss"), F.count("*").alias("n"))
    pairs = edges.join(d, edges[cell] == d["_k"]).withColumnRenamed("_d", "_a").drop("_k").join(d, F.col("neighbor") == F.col("_k")).agg(F.sum(F.col("_a") * F.col("_d")).alias("_x"), F.count("*").alias("n_edges"))
    return pairs.join(F.broadcast(total)).select("n", "n_edges", (F.col("n") / F.col("n_edges") * F.try_divide(F.col("_x"), F.nullif("_ss", F.lit(0.0)))).alias("moran"))


def within(points: DataFrame, polygons: DataFrame, size: float, point: str = "point", polygon: str = "polygon") -> DataFrame:
    """point and polygon of every point (x, y) inside a polygon (ring: array of structs x, y; closed or not).

    Both sides are dealt to square cells of that size (about a polygon's extent), a polygon to all that its bounds meet, so
    only those of one cell are held against each other; crossings of the ring's edges decide.
    """
    ring = F.col("ring")
    box = polygons.select(polygon, "ring", *(f(F.transform(ring, lambda p: p[c])).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.array_min, "low"), (F.array_max, "high"))))
    cells = box.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("_lowx"), 0.0, size), cell_of(F.col("_highx"), 0.0, size)))).withColumn("_cy", F.explode(F.sequence(cell_of(F.col("_lowy"), 0.0, size), cell_of(F.col("_highy"), 0.0, size))))
    own = points.select(point, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    own = own.withColumns({"_cx": cell_of(F.col("x"), 0.0, size), "_cy": cell_of(F.col("y"), 0.0, size)})
    near = own.join(cells, ["_cx", "_cy"]).filter((F.col("x") >= F.col("_lowx")) & (F.col("x") <= F.col("_highx")) & (F.col("y") >= F.col("_lowy")) & (F.col("y") <= F.col("_highy")))
    x, y = F.col("x"), F.col("y")

    def crossing(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))), 1).otherwise(0)

    crossings = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), crossing), F.lit(0), lambda s, c: s + c)
    return near.filter(crossings % 2 == 1).select(point, polygon)


def zones(blobs: DataFrame, distance: float, blob: str = "blob") -> DataFrame:
    """blob and zone (its least blob) of blobs (x, y) that chains of steps of at most `distance` link.

    Cells are so small that all blobs of one are linked, so components are of cells, however many blobs lie in each. Two cells near one another
    are linked by their outermost blobs, if these are near enough; only where cells are in different zones after that, all blobs
    of theirs that can reach the other cell are held against each other, on each line (equal y, or x for cells above one another) the foremost.
    """
    rows = blobs.select(F.col(blob).cast("long").alias("_b"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = rows.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("_b").isNotNull())
    placed = placed.withColumns({"_cx": cell_of(F.col("x"), 0.0, 0.7 * distance), "_cy": cell_of(F.col("y"), 0.0, 0.7 * distance)})  # 0.7: their diagonal is shorter than the distance
    ends = [f(F.struct(k.alias("k"), "x", "y")) for k in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for f in (F.min, F.max)]
    cells = materialize(placed.groupBy("_cx", "_cy").agg(F.min("_b").alias("_cell"), F.array_distinct(F.transform(F.array(*ends), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("_ends"),
                                                         *(f(c).alias(f"_{n}{c}") for c in "xy" for f, n in ((F.min, "low"), (F.max, "high")))), "zone-cells")
    own = placed.select("_b", "_cx", "_cy").join(cells.select("_cx", "_cy", "_cell"), ["_cx", "_cy"])
    again = own.groupBy("_b").agg(F.min("_cell").alias("a"), F.max("_cell").alias("_z"), F.collect_set("_cell").alias("_all")).filter("a <> _z").select("a", F.explode("_all").alias("b"))  # a blob of several places links their cells

    ahead = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0))))
    there = cells.select(*(F.col(c).alias(f"{c}2") for c in cells.columns))
    pairs = cells.withColumn("_s", ahead).join(there, (F.col("_cx") + F.col("_s.dx") == F.col("_cx2")) & (F.col("_cy") + F.col("_s.dy") == F.col("_cy2")))
    gap = sum((F.pow(F.greatest(F.col(f"_low{c}2") - F.col(f"_high{c}"), F.col(f"_low{c}") - F.col(f"_high{c}2"), F.lit(0.0)), 2) for c in "xy"), F.lit(0.0))
    reach = distance * distance * (1 + 1e-9)  # bounds are passed generously, blobs are held against the distance itself
    met = F.exists("_ends", lambda p: F.exists("_ends2", lambda q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) <= distance * distance))
    pairs = materialize(pairs.filter(gap <= reach).withColumn("_met", met), "zone-pairs")
    first = pairs.filter("_met").select(F.col("_cell").alias("a"), F.col("_cell2").alias("b")).unionByName(again)
    found = connected_components(first)

    open_ = pairs.filter("not _met").drop("_ends", "_ends2")
    for n in ("_cell", "_cell2"):
        open_ = open_.join(found.select(F.col("node").alias(n), F.col("component").alias("_zone")), n, "left").withColumn(n, F.coalesce("_zone", n)).drop("_zone")
    open_ = materialize(open_.filter("_cell <> _cell2"), "zone-pairs")
    if not open_.isEmpty():
        def fronts(here: str, other: str, sign: int) -> DataFrame:
            """Blobs of one side of each pair: on each line the foremost towards the other cell."""
            to = open_.select("_cx", "_cy", "_s", "_cx2", "_cy2", *(f"_{n}{c}{other}" for n in ("low", "high") for c in "xy"), "_cell", "_cell2")
            near = to.join(placed.select(F.col("_cx").alias(f"_cx{here}"), F.col("_cy").alias(f"_cy{here}"), "x", "y"), [f"_cx{here}", f"_cy{here}"])
            off = sum((F.pow(F.greatest(F.col(f"_low{c}{other}") - F.col(c), F.col(c) - F.col(f"_high{c}{other}"), F.lit(0.0)), 2) for c in "xy"), F.lit(0.0))
            level = F.col("_s.dx") > 0
            line, front = F.when(level, F.col("y")).otherwise(F.col("x")), sign * F.when(level, F.col("x")).otherwise(F.col("y"))
            return near.filter(off <= reach).groupBy("_cx", "_cy", "_s", "_cell", "_cell2", line.alias(f"_l{sign + 1}")).agg(F.max(front).alias("_f")).withColumnRenamed("_f", f"_f{sign + 1}")

        a, c = fronts("", "2", 1), fronts("2", "", -1)
        step = F.pow(F.col("_l2") - F.col("_l0"), 2) + F.pow(F.col("_f2") + F.col("_f0"), 2) <= distance * distance
        more = a.join(c.drop("_cell", "_cell2"), ["_cx", "_cy", "_s"]).filter(step).select(F.col("_cell").alias("a"), F.col("_cell2").alias("b")).distinct()
        second = connected_components(more)
        found = found.select("node", F.col("component").alias("_to")).join(second.withColumnsRenamed({"node": "_to", "component": "_end"}), "_to", "left").select("node", F.coalesce("_end", "_to").alias("component")).unionByName(
            second.join(found.select("node"), "node", "left_anti"))
    zone = own.join(found.withColumnsRenamed({"node": "_cell", "component": "_zone"}), "_cell", "left").groupBy("_b").agg(F.min(F.coalesce("_zone", "_cell")).alias("zone"))
    out = materialize(rows.select("_b").join(zone, "_b", "left").select(F.col("_b").alias(blob), F.coalesce("zone", "_b").alias("zone")), "zones")
    release(blobs.sparkSession, cells, pairs, open_)
    return out


def backfill_distance(df: DataFrame, computed: str, baked: str, tolerance: float) -> DataFrame:
    """The baked distance where there is one, else the computed one: `distance`; and `disagrees` where both are there and differ by more than the tolerance."""
    both = F.abs(F.col(baked) - F.col(computed)) > tolerance
    return df.withColumns({"distance": F.coalesce(baked, computed), "disagrees": F.coalesce(both, F.lit(False))})


def band_means(pixels: DataFrame, keys: list[str], value: str, total: str = "n") -> DataFrame:
    """Mean of a band and the share of a cell's pixels that have it."""
    return pixels.groupBy(*keys).agg(F.avg(value).alias(f"{value}_mean"), F.count("*").alias(total), (F.count(value) / F.count("*")).alias(f"{value}_fraction"))
