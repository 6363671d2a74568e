"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large) or the smaller neighbours of every node to its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
    linked = near.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that edges (a, b; long) name.

    Self-loops, repeated edges and either direction are fine; rows with a null are passed over. A
    star operation hangs nodes on their least neighbour; alternating large and small stars ends, after
    about the logarithm of the longest path, with each component one star. Every round is written to the
    shared folder, so lineage stays short; sums over the edges tell when nothing changes any more.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
    every = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    spark, state, current = edges.sparkSession, None, materialize(edges.filter("a <> b").distinct(), "edges")
    while True:
        before, current = current, materialize(_star(_star(current, True), False), "edges")
        delete(spark, before._table_path)
        after = tuple(current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if after == state:
            break
        state = after
    found = every.join(current.select(F.col("a").alias("node"), F.col("b").alias("_to")), "node", "left").select("node", F.coalesce("_to", "node").alias("component"))
    out = materialize(found, "components")
    delete(spark, current._table_path)
    return out
