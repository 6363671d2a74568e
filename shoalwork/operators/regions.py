"""Regions: classes of cells, contiguous parts, merging of small ones, names and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize
from .zonal import adjacency, patches


def setting_class(river: Column, openness: Column, river_cut: float, shelter_cut: float, exposed_cut: float) -> tuple[Column, Column]:
    """River mouth, sheltered, exposed or open, the first that holds, and the rule that decided as text."""
    label = F.when(river <= river_cut, "river").when(openness <= shelter_cut, "sheltered").when(openness >= exposed_cut, "exposed").otherwise("open")
    rule = F.when(river <= river_cut, F.format_string(f"river distance %.1f <= {river_cut}", river)).when(openness <= shelter_cut, F.format_string(f"openness %.3f <= {shelter_cut}", openness)).when(openness >= exposed_cut, F.format_string(f"openness %.3f >= {exposed_cut}", openness)).otherwise("no rule")
    return label, rule


def compass_tag(dx: Column, dy: Column, span_x: float, span_y: float, least: float = 0.15) -> Column:
    """N, S, E, W or two of them where the offset is over a share of the span; central if neither."""
    ns = F.when(dy > least * span_y, "N").when(dy < -least * span_y, "S").otherwise("")
    ew = F.when(dx > least * span_x, "E").when(dx < -least * span_x, "W").otherwise("")
    tag = F.concat(ns, ew)
    return F.when(tag == "", "central").otherwise(tag)


def capture_share(df: DataFrame, value: str, cut: float) -> float:
    """Share of the rows at or under a cut."""
    return df.agg(F.avg((F.col(value) <= cut).cast("double"))).first()[0] or 0.0


def resolve_threshold(df: DataFrame, value: str, cut: float, quantile: float, low: float = 0.02, high: float = 0.98) -> tuple[float, str]:
    """The configured cut, or the quantile instead where the cut tells (almost) nothing apart."""
    row = df.agg(F.avg((F.col(value) <= cut).cast("double")).alias("share"), F.percentile(value, quantile).alias("q")).first()
    if row.share is not None and low <= row.share <= high:
        return cut, "configured"
    return (row.q, "quantile") if row.q is not None else (cut, "configured")


def choose_columns(df: DataFrame, preferences: dict[str, list[str]]) -> dict[str, str | None]:
    """The first column of each role that the table has."""
    return {role: next((c for c in names if c in df.columns), None) for role, names in preferences.items()}


def merge_small(parts: DataFrame, borders: DataFrame, features: list[str], least_cells: int, least_area: float, most_distance: float = float("inf")) -> DataFrame:
    """part and into, where each part ends up when small ones join the neighbour most like them, smallest first.

    parts: id (long), n_cells, area and features of every part; borders: a and b, pairs of ids that touch. A small part has fewer cells or less area than the least.
    Of equally like neighbours the larger is taken, then the lower id; features become means by cells. A part without a neighbour within the distance stays,
    until one joins it. The result is that of one merge at a time, by number of cells and id: in each round those small parts merge that come
    before all other small parts up to two borders away. Nothing that comes later can change their neighbours before their turn, and no two of them have a neighbour in common.
    Parts inside one other part can only join that one, so all of them that come before the rest around it join it in one round (without a most distance).
    Small parts that lie between the same large ones take a round each, as every one changes what the next is held against.
    """
    spark = parts.sparkSession
    two = borders.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = materialize(two.unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "borders")
    own = parts.select(F.col("id").cast("long").alias("id"), F.col("n_cells").cast("long").alias("n_cells"), F.col("area").cast("double").alias("area"), *(F.col(f).cast("double").alias(f) for f in features), F.lit(True).alias("_open"))
    own, merges = materialize(own, "parts"), []
    small = F.col("_open") & ((F.col("n_cells") < least_cells) | (F.col("area") < least_area))
    turn = F.struct("n_cells", "id")
    while True:
        waiting = own.filter(small).select("id", turn.alias("_turn"))
        if waiting.isEmpty():
            break
        degree = edges.groupBy("a").agg(F.count("*").alias("_degree"))
        alone = edges.join(degree.filter("_degree = 1"), "a").join(degree.select(F.col("a").alias("b"), F.col("_degree").alias("_other")), "b").filter("_other > 1").select(F.col("a").alias("id"), F.lit(most_distance == float("inf")).alias("_inside"))
        waiting = waiting.join(alone, "id", "left").withColumn("_inside", F.coalesce("_inside", F.lit(False)))
        waiting = materialize(waiting.withColumn("_free", F.when(~F.col("_inside"), F.col("_turn"))), "waiting")
        # the first small part within one border of each part, then within two
        near = waiting.select(F.col("id").alias("at"), "_turn", "_free").unionByName(edges.join(waiting, edges.b == waiting.id).select(F.col("a").alias("at"), "_turn", "_free"))
        first = near.groupBy("at").agg(F.min("_turn").alias("_first"), F.min("_free").alias("_first_free"))
        reach = first.unionByName(edges.join(first, edges.b == first["at"]).select(F.col("a").alias("at"), "_first", "_first_free")).groupBy("at").agg(F.min("_first").alias("_first"), F.min("_first_free").alias("_first_free"))
        now = F.when(F.col("_inside"), F.col("_first_free").isNull() | (F.col("_turn") < F.col("_first_free"))).otherwise(F.col("_turn") == F.col("_first"))
        chosen = waiting.join(reach, waiting.id == reach["at"]).filter(now).select("id").join(own, "id")
        x, y = chosen.alias("x"), own.alias("y")
        apart = F.sqrt(sum((F.pow(F.col(f"x.{f}") - F.col(f"y.{f}"), 2) for f in features), F.lit(0.0)))
        facing = x.join(edges, F.col("x.id") == F.col("a"), "left").join(y, F.col("b") == F.col("y.id"), "left").withColumn("_apart", apart)
        best = F.min(F.when(F.col("y.id").isNotNull() & (F.col("_apart") <= most_distance), F.struct(F.col("_apart"), (-F.col("y.n_cells")).alias("_n"), F.col("y.id").alias("into"))))
        found = materialize(facing.groupBy(F.col("x.id").alias("id")).agg(best["into"].alias("into")), "chosen")
        joined = found.filter("into is not null")
        gone = joined.join(own, "id").groupBy(F.col("into").alias("_to")).agg(F.sum("n_cells").alias("_n"), F.sum("area").alias("_area"), *(F.sum(F.col(f) * F.col("n_cells")).alias(f"_{f}") for f in features))
        stay = own.join(joined.select("id"), "id", "left_anti").join(found.filter("into is null").select("id", F.lit(True).alias("_alone")), "id", "left")
        total = F.col("n_cells") + F.coalesce("_n", F.lit(0))
        grown = stay.join(gone, F.col("id") == F.col("_to"), "left").select(
            "id", total.alias("n_cells"), (F.col("area") + F.coalesce("_area", F.lit(0.0))).alias("area"),
            *(F.when(F.col("_to").isNotNull(), (F.col(f) * F.col("n_cells") + F.col(f"_{f}")) / total).otherwise(F.col(f)).alias(f) for f in features),
            (F.col("_to").isNotNull() | (F.col("_open") & F.col("_alone").isNull())).alias("_open"))
        moved = joined.select(F.col("id").alias("_from"), "into")
        ends = edges.join(moved.withColumnRenamed("_from", "a"), "a", "left").select(F.coalesce("into", "a").alias("a"), "b")
        ends = ends.join(moved.withColumnRenamed("_from", "b"), "b", "left").select("a", F.coalesce("into", "b").alias("b")).filter("a <> b").distinct()
        new_own, new_edges = materialize(grown, "parts"), materialize(ends, "borders")
        for t in (own, edges, waiting):
            delete(spark, t._table_path)
        own, edges = new_own, new_edges
        merges.append(found)
    ends = parts.select(F.col("id").cast("long").alias("part"), F.col("id").cast("long").alias("into"))
    if merges:
        step = merges[0]
        for t in merges[1:]:
            step = step.unionByName(t)
        ends = _followed(ends, materialize(step.filter("into is not null"), "merges"))
    out = materialize(ends, "merged")
    for t in (own, edges, *merges):
        delete(spark, t._table_path)
    return out


def _followed(parts: DataFrame, merges: DataFrame) -> DataFrame:
    """part and into at the end of the merges of merges (id, into): each round looks twice as far."""
    spark, state = parts.sparkSession, materialize(merges, "merges")
    while True:
        on = state.select(F.col("id").alias("into"), F.col("into").alias("_on"))
        both = materialize(state.join(on, "into", "left").select("id", F.coalesce("_on", "into").alias("into"), F.col("_on").isNotNull().alias("_moved")), "merges")
        delete(spark, state._table_path)
        moved, state = not both.filter("_moved").isEmpty(), both.drop("_moved")
        state._table_path = both._table_path
        if not moved:
            break
    return parts.select("part").join(state.withColumnRenamed("id", "part"), "part", "left").select("part", F.coalesce("into", "part").alias("into"))


def build_regions(cells: DataFrame, label: str, features: list[str], area: str, least_cells: int, least_area: float, contiguity: str = "queen", most_distance: float = float("inf")) -> DataFrame:
    """cell, label and region of every cell: touching cells of a label, small parts merged, numbered by size (then by least part).

    cells has cell (a whole number), ix, iy, the label, the features and the area. Parts and their borders stay tables, however many they are.
    """
    p = materialize(patches(cells, label, contiguity=contiguity).withColumn("patch", F.col("patch").cast("long")), "patches")
    table = p.groupBy(F.col("patch").alias("id")).agg(F.count("*").alias("n_cells"), F.sum(area).alias("area"), *(F.avg(f).alias(f) for f in features))
    into = merge_small(materialize(table, "part-table"), adjacency(p, "patch"), features, least_cells, least_area, most_distance)
    out = p.join(into.select(F.col("part").alias("patch"), F.col("into").alias("part")), "patch")
    size = out.groupBy("part").agg(F.count("*").alias("_n"))
    order = numbered(size).select("part", F.format_string("R%02d", F.col("_rank")).alias("region"))
    return out.join(order, "part").select("cell", label, "region")


def numbered(sizes: DataFrame) -> DataFrame:
    """part, _n and _rank, from 1 by falling size, then part: ranks within a size, after the numbers of larger parts by size (distinct sizes are few, as they add up to the cells)."""
    by_size = sizes.groupBy("_n").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    ranked = sizes.withColumn("_own", F.row_number().over(Window.partitionBy("_n").orderBy("part")))
    return ranked.join(by_size, "_n").select("part", "_n", (F.col("_before") + F.col("_own")).alias("_rank"))
