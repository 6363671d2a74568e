"""Folds for validation: by hashed blocks, by date, by lattice and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_folds(df: DataFrame, block: str, folds: int = 5, repeats: int = 1) -> DataFrame:
    """Every row once for each repeat, with a fold that depends on its block alone.

    Blocks are put in the order of a hash and dealt out in turn, so folds hold equally many blocks. Only distinct blocks are
    ordered; the folds go back by join.
    """
    blocks = df.select(block).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.md5(F.concat_ws(":", F.col(block).cast("string"), F.col("repeat").cast("string")))
    order = Window.partitionBy("repeat").orderBy(key, block)
    return df.join(blocks.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(folds)).cast("int")), block)


def square_blocks(x_km: Column, y_km: Column, size: float = 10.0) -> Column:
    return F.concat_ws("_", F.floor(x_km / size).cast("string"), F.floor(y_km / size).cast("string"))


def numbered_blocks(df: DataFrame, block: str, folds: int = 5) -> DataFrame:
    """Folds 1 to `folds` dealt to blocks in sorted order. The order of the distinct blocks is made in one task: a few hundred bytes for each block of the area."""
    ids = df.select(block).distinct().withColumn("fold", (F.pmod(F.row_number().over(Window.orderBy(block)) - 1, F.lit(folds)) + 1).cast("int"))
    return df.join(ids, block)


def last_periods(df: DataFrame, period: str, folds: int = 4) -> DataFrame:
    """The last `folds` periods as folds 1 (oldest) to `folds`; 0 before them."""
    order = df.select(period).distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc(period))))
    return df.join(F.broadcast(order), period).withColumn("fold", F.when(F.col("_r") <= folds, folds + 1 - F.col("_r")).otherwise(0).cast("int")).drop("_r")


def leave_one_out(df: DataFrame, group: str, truth: str) -> DataFrame:
    """One fold per group: its rows, the rows and classes to train on, and whether the fold is usable (a class more than one)."""
    n = df.agg(F.count("*").alias("_n"))
    per = df.groupBy(group, truth).count()
    total = per.groupBy(truth).agg(F.sum("count").alias("_all"))
    left = per.select(group).distinct().crossJoin(F.broadcast(total)).join(per, [group, truth], "left").withColumn("_left", F.col("_all") - F.coalesce("count", F.lit(0)))
    out = left.groupBy(group).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_test"), F.count_if(F.col("_left") > 0).alias("n_classes")).join(F.broadcast(n))
    return out.select(group, "n_test", (F.col("_n") - F.col("n_test")).alias("n_train"), "n_classes", (F.col("n_classes") > 1).alias("usable"))


def held_out_blocks(df: DataFrame, block: str, fraction: float = 0.2) -> DataFrame:
    """Whole blocks in hash order until the fraction of rows is reached. One task adds up the blocks' counts, not rows."""
    sizes = df.groupBy(block).count()
    order = Window.orderBy(F.md5(F.col(block).cast("string")), block).rowsBetween(Window.unboundedPreceding, -1)
    total = sizes.agg(F.sum("count").alias("_n"))
    chosen = sizes.withColumn("_before", F.coalesce(F.sum("count").over(order), F.lit(0))).join(F.broadcast(total)).withColumn("held_out", F.col("_before") < F.col("_n") * fraction)
    return df.join(chosen.select(block, "held_out"), block)


def steadiest(results: DataFrame, model: str, mean: str, std: str, order: list[str], tolerance: float = 1.0) -> DataFrame:
    """Models within a deviation of the leader; the first of them in order of simplicity is chosen."""
    best = results.agg(F.max(mean).alias("_best"), F.max_by(std, mean).alias("_sd"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(model)), F.lit(0)), F.lit(len(order) + 1))
    near = results.join(F.broadcast(best)).withColumn("tied", F.col(mean) >= F.col("_best") - tolerance * F.col("_sd")).withColumn("_rank", rank)
    pick = near.filter("tied").agg(F.min_by(model, "_rank").alias("_pick"))
    return near.join(F.broadcast(pick)).withColumn("chosen", F.col(model) == F.col("_pick")).drop("_best", "_sd", "_rank", "_pick")
