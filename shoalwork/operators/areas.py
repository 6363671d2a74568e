"""Areas of classified pixels: by class, by confidence, hard and soft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def class_area(pixels: DataFrame, keys: list[str], code: str, classes: dict[int, str], pixel_m2: float) -> DataFrame:
    """Pixels and area of every class of each key, zero for classes without a pixel."""
    spark = pixels.sparkSession
    names = F.broadcast(spark.createDataFrame(list(classes.items()), f"{code} int, class_name string"))
    counts = pixels.groupBy(*keys, code).count()
    grid = pixels.select(*keys).distinct().crossJoin(names)  # a few classes for each key
    out = grid.join(counts, [*keys, code], "left").withColumn("n_pixels", F.coalesce("count", F.lit(0))).drop("count")
    return out.withColumn("area_ha", F.col("n_pixels") * F.lit(pixel_m2 / 1e4)).withColumn("area_km2", F.col("n_pixels") * F.lit(pixel_m2 / 1e6))


def raster_metrics(pixels: DataFrame, keys: list[str], code: str, target: int, nodata: int = 255) -> DataFrame:
    """Target and valid pixels and the share of the target."""
    valid = F.coalesce(F.col(code) != nodata, F.lit(False))
    return pixels.groupBy(*keys).agg(F.count_if(valid & (F.col(code) == target)).alias("n_target"), F.count_if(valid).alias("n_valid")).withColumn("cover_percent", F.lit(100.0) * ratio(F.col("n_target"), F.col("n_valid")))


def confident_area(pixels: DataFrame, keys: list[str], code: str, probability: str, thresholds: list[float], pixel_m2: float) -> DataFrame:
    """Pixels of each class whose probability (0 to 100) reaches each threshold (0 to 1)."""
    steps = F.explode(F.array(*map(F.lit, thresholds)))
    flags = pixels.groupBy(*keys, code).agg(*(F.count_if(F.col(probability) >= t * 100).alias(f"_t{i}") for i, t in enumerate(thresholds)))
    out = flags.select(*keys, code, *(F.col(f"_t{i}") for i in range(len(thresholds))), steps.alias("threshold"))
    n = F.coalesce(*(F.when(F.col("threshold") == t, F.col(f"_t{i}")) for i, t in enumerate(thresholds)))
    return out.select(*keys, code, "threshold", n.alias("n_pixels"), (n * F.lit(pixel_m2 / 1e4)).alias("area_ha"))


def hard_soft(pixels: DataFrame, keys: list[str], code: str, probability: str, target: int, pixel_m2: float) -> DataFrame:
    """Target area by count and by summed probability (pixels without one are left out), gap, ratio and mean probability."""
    hit = (F.col(code) == target) & F.col(probability).isNotNull()
    p = F.greatest(F.least(F.col(probability) / 100.0, F.lit(1.0)), F.lit(0.0))
    out = pixels.groupBy(*keys).agg(F.count_if(hit).alias("hard_pixels"), F.coalesce(F.sum(F.when(hit, p)), F.lit(0.0)).alias("soft_pixels"))
    k = pixel_m2 / 1e4
    return out.select(*keys, "hard_pixels", (F.col("hard_pixels") * k).alias("hard_ha"), (F.col("soft_pixels") * k).alias("soft_ha"), ((F.col("hard_pixels") - F.col("soft_pixels")) * k).alias("gap_ha"), ratio(F.col("soft_pixels"), F.col("hard_pixels")).alias("mean_probability"))


def zonal_counts(pixels: DataFrame, keys: list[str], cell: Column, code: str, target: int, nodata: int = 255) -> DataFrame:
    """Pixels by grid cell; the cell is arithmetic on coordinates, so no spatial join is needed."""
    return raster_metrics(pixels.withColumn("cell", cell), [*keys, "cell"], code, target, nodata)


def zonal_soft(pixels: DataFrame, keys: list[str], code: str, probability: str, target: int) -> DataFrame:
    """Target weight of each cell by probability; a missing probability counts as sure."""
    conf = F.coalesce(F.col(probability) / 100.0, F.lit(1.0))
    return pixels.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(code) == target, conf)), F.lit(0.0)).alias("soft_target"), F.count(code).alias("n_valid")).withColumn("soft_cover", ratio(F.col("soft_target"), F.col("n_valid")))


def mosaic(tiles: DataFrame, pixel: list[str], value: str, order: list[str], nodata: int = 255) -> DataFrame:
    """The first tile's value that is no nodata, by pixel. Where tiles tie in `order`, any of theirs may come, so the columns should tell all apart."""
    valid = (F.col(value) != nodata) & F.col(order[0]).isNotNull()
    return tiles.groupBy(*pixel).agg(F.coalesce(F.min_by(value, F.when(valid, F.struct(*order))), F.lit(nodata)).alias(value))


def wide_areas(df: DataFrame, rows: list[str], names: list[str], column: str, value: str) -> DataFrame:
    """Sums of value by rows and by the names of a column."""
    return df.groupBy(*rows).pivot(column, names).sum(value)


def scene_gate(pixels: DataFrame, keys: list[str], valid: Column, least_fraction: float, least_pixels: int) -> DataFrame:
    """Valid pixels, their share and whether a scene has enough of them."""
    out = pixels.groupBy(*keys).agg(F.count_if(valid).alias("n_valid"), F.count("*").alias("n_pixels")).withColumn("valid_fraction", ratio(F.col("n_valid"), F.col("n_pixels")))
    return out.withColumn("passes", (F.col("valid_fraction") >= least_fraction) & (F.col("n_valid") >= least_pixels))


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
