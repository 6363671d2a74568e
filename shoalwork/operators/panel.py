"""Cell-by-month panels: building, coverage, weighting and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index, ratio, weighted_mean


def reduce_duplicates(df: DataFrame, keys: list[str], part: str, whole: str, sources: str | None = None) -> DataFrame:
    """One row per key: means of both areas and their ratio (never a mean of ratios), and the sources joined."""
    aggs = [F.avg(part).alias(part), F.avg(whole).alias(whole), F.count("*").alias("n_rows")]
    if sources:
        aggs.append(F.array_join(F.array_sort(F.collect_set(sources)), "; ").alias(sources))
    return df.groupBy(*keys).agg(*aggs).withColumn("cover", ratio(F.col(part), F.col(whole)))


def valid_cells(df: DataFrame, pixels: str, least_pixels: int, fraction: str | None = None, least_fraction: float = 0.0) -> DataFrame:
    """Cell-months with enough valid pixels and a large enough valid share."""
    keep = F.col(pixels) >= least_pixels
    return df.filter(keep & (F.col(fraction) >= least_fraction) if fraction else keep)


def validity_report(df: DataFrame, pixels: str, least_pixels: int) -> DataFrame:
    """How many rows a validity filter keeps and drops, and why."""
    ok = F.col(pixels) >= least_pixels
    return df.groupBy(F.when(ok, "kept").when(F.col(pixels).isNull(), "no pixels").otherwise("few pixels").alias("outcome")).agg(F.count("*").alias("n"))


def coverage_audit(df: DataFrame, cell: str, area: str, least_cells: float = 0.9, least_area: float | None = None, month: str = "month") -> DataFrame:
    """For each month: cells seen of all cells, area seen of all cells' largest areas, and whether it is kept, with the reason. One row per cell and month."""
    totals = df.groupBy(cell).agg(F.max(area).alias("_most")).agg(F.count("*").alias("n_eligible"), F.sum("_most").alias("area_eligible"))
    months = df.groupBy(month).agg(F.count(cell).alias("n_cells"), F.sum(area).alias("area_seen"))
    out = months.join(F.broadcast(totals)).withColumn("cell_fraction", ratio(F.col("n_cells"), F.col("n_eligible"))).withColumn("area_fraction", ratio(F.col("area_seen"), F.col("area_eligible")))
    few, small = F.col("cell_fraction") < least_cells, F.lit(False) if least_area is None else F.col("area_fraction") < least_area
    return out.withColumn("kept", ~(few | small)).withColumn("reason", F.when(few & small, "few cells; small area").when(few, "few cells").when(small, "small area").otherwise("kept"))


def covered_months(df: DataFrame, audit: DataFrame, month: str = "month") -> DataFrame:
    """The rows of months that an audit keeps."""
    return df.join(F.broadcast(audit.filter("kept").select(month)), month, "left_semi")


def steady_cells(df: DataFrame, cell: str, least: float = 0.8, month: str = "month") -> DataFrame:
    """Cells seen in a share of all months; every cell with its share and whether it stays."""
    months = df.agg(F.countDistinct(month).alias("n_months"))
    seen = df.groupBy(cell).agg(F.countDistinct(month).alias("n_seen"))
    return seen.join(F.broadcast(months)).withColumn("month_fraction", ratio(F.col("n_seen"), F.col("n_months"))).withColumn("steady", F.col("month_fraction") >= least)


def monthly_series(df: DataFrame, keys: list[str], part: str, whole: str, drivers: list[str]) -> DataFrame:
    """Pooled cover and area-weighted driver means (of the cells that have the driver) per month."""
    return df.groupBy(*keys).agg(
        F.sum(part).alias(part), F.sum(whole).alias(whole), F.countDistinct("cell").alias("n_cells"),
        ratio(F.sum(part), F.sum(whole)).alias("cover"), *(weighted_mean(F.col(d), F.col(whole)).alias(d) for d in drivers),
    )


def regional_series(df: DataFrame, regions: DataFrame, cell: str, part: str, whole: str, drivers: list[str], least_cells: float = 0.7, least_area: float = 0.7, month: str = "month") -> DataFrame:
    """monthly_series by region, with cover and drivers null where too few of a region's cells or too little area are seen.

    regions has cell, region. A region's area is the sum of its cells' largest areas.
    """
    rows = df.join(regions, cell)
    most = rows.groupBy("region", cell).agg(F.max(whole).alias("_a")).groupBy("region").agg(F.sum("_a").alias("region_area"))
    size = regions.groupBy("region").agg(F.count("*").alias("region_cells"))
    out = monthly_series(rows.withColumnRenamed(cell, "cell"), ["region", month], part, whole, drivers).join(most.join(size, "region"), "region")
    out = out.withColumn("cell_fraction", ratio(F.col("n_cells"), F.col("region_cells"))).withColumn("area_fraction", ratio(F.col(whole), F.col("region_area")))
    ok = (F.col("cell_fraction") >= least_cells) & (F.col("area_fraction") >= least_area)
    return out.withColumn("passes", ok).withColumns({c: F.when(ok, F.col(c)) for c in ["cover", *drivers]})


def fill_gaps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first source's rows, and the second's for keys that the first lacks."""
    return first.withColumn("filled", F.lit(False)).unionByName(second.join(first.select(*keys), keys, "left_anti").withColumn("filled", F.lit(True)), allowMissingColumns=True)


def overlap(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that both sources have, with both values."""
    return first.select(*keys, F.col(value).alias("first_value")).join(second.select(*keys, F.col(value).alias("second_value")), keys)


def climatology(train: DataFrame, target: DataFrame, value: str, cell: str = "cell", month: str = "month", least: int = 2) -> DataFrame:
    """Expected value of each target row: the mean of its cell in that calendar month (from `least` rows on), else of its
    cell, else of the calendar month, else of all. The level used is recorded."""
    t = train.filter(F.col(value).isNotNull()).withColumn("_m", F.month(month))
    sums = t.groupBy(cell, "_m").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))  # the other levels are sums of these

    def mean(keys: list[str], name: str, rows: int = 1) -> DataFrame:
        return sums.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias(name), F.sum("_n").alias("_n")).filter(F.col("_n") >= rows).drop("_n")

    out = target.withColumn("_m", F.month(month))
    out = out.join(mean([cell, "_m"], "_c2", least), [cell, "_m"], "left").join(mean([cell], "_c1"), cell, "left").join(F.broadcast(mean(["_m"], "_c0")), "_m", "left")
    out = out.join(F.broadcast(sums.agg((F.sum("_s") / F.sum("_n")).alias("_all"))))
    level = F.when(F.col("_c2").isNotNull(), "cell_month").when(F.col("_c1").isNotNull(), "cell").when(F.col("_c0").isNotNull(), "month").otherwise("global")
    return out.withColumn("climatology", F.coalesce("_c2", "_c1", "_c0", "_all")).withColumn("climatology_level", level).drop("_m", "_c2", "_c1", "_c0", "_all")


def two_way_demean(df: DataFrame, value: str, by: list[str], out: str = "demeaned") -> DataFrame:
    """The value without its means by the first and by the second key, plus the overall mean."""
    total = df.agg(F.avg(value).alias("_grand"))
    rows = df.join(F.broadcast(total))
    for i, k in enumerate(by):  # means by partial aggregation and join, so a key with few values does not gather rows in few tasks
        rows = rows.join(df.groupBy(k).agg(F.avg(value).alias(f"_mean{i}")), k)
    return rows.withColumn(out, F.col(value) - F.col("_mean0") - F.col("_mean1") + F.col("_grand")).select(*df.columns, out)


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their sample deviation; null for a constant column."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    out = df.join(F.broadcast(stats))
    return out.select(*df.columns, *(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(f"_s_{c}", F.lit(0.0))).alias(f"{c}_z") for c in columns))


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that are neither all null nor constant, in one pass."""
    row = df.agg(*(F.count(c).alias(f"n_{c}") for c in columns), *((F.min(c) < F.max(c)).alias(f"v_{c}") for c in columns)).first()
    return [c for c in columns if row[f"n_{c}"] and row[f"v_{c}"]]


def static_table(df: DataFrame, cell: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row per cell of the columns that do not change within any cell."""
    per = df.groupBy(cell).agg(*(F.min(c).alias(c) for c in columns), *((F.max(c) - F.min(c)).alias(f"_r_{c}") for c in columns))
    spread = per.agg(*(F.max(f"_r_{c}").alias(c) for c in columns)).first()
    return per.select(cell, *(c for c in columns if spread[c] is None or spread[c] <= tolerance))


def merge_tables(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by key; columns of both take base's value where it has one."""
    shared = [c for c in extra.columns if c in base.columns and c not in keys]
    out = base.join(extra.withColumnsRenamed({c: f"_x_{c}" for c in shared}), keys, "full_outer")
    return out.withColumns({c: F.coalesce(c, f"_x_{c}") for c in shared}).drop(*(f"_x_{c}" for c in shared))


def append_missing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of extra whose key it lacks."""
    return base.unionByName(extra.join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of base with the same key."""
    return base.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def onshore(df: DataFrame, u: Column, v: Column, gx: Column, gy: Column) -> DataFrame:
    """Wind against a gradient of distance to shore."""
    size = F.sqrt(gx * gx + gy * gy)
    return df.withColumn("onshore", -F.try_divide(u * gx + v * gy, F.nullif(size, F.lit(0.0))))


def antecedent_sum(df: DataFrame, keys: list[str], day: str, value: str, days: int, out: str) -> DataFrame:
    """Sum over the days up to and including this one."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)
    return df.withColumn(out, F.sum(value).over(w))


def mi(month: str = "month") -> Column:
    return month_index(F.col(month))


def effective_depth(df: DataFrame, depth: str = "depth", level: str = "level") -> DataFrame:
    """Adds `level_anomaly` (the level less its mean over all rows) and `effective_depth` (depth and anomaly)."""
    mean = df.agg(F.avg(level).alias("_mean"))  # one row
    out = df.join(F.broadcast(mean)).withColumn("level_anomaly", F.col(level) - F.col("_mean")).drop("_mean")
    return out.withColumn("effective_depth", F.col(depth) + F.col("level_anomaly"))


def climate_months(df: DataFrame, keys: list[str], means: list[str], sums: list[str]) -> DataFrame:
    """Monthly means of some columns and sums of others."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(f"{c}_mean") for c in means), *(F.sum(c).alias(f"{c}_sum") for c in sums))


def merge_checked(base: DataFrame, extra: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """A left join that also tells whether both sides agree on where they come from: `agrees` (null without a partner)."""
    other = extra.withColumnsRenamed({c: f"_o_{c}" for c in same})
    agrees = F.lit(True)
    for c in same:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = base.join(other.withColumn("_there", F.lit(True)), keys, "left")
    return out.withColumn("agrees", F.when(F.col("_there"), agrees)).drop("_there", *(f"_o_{c}" for c in same))


def synthetic_months(spark, n: int, effect: float = 0.8, seed: int = 42) -> DataFrame:
    """A monthly series with a known effect of a driver: month, driver, season, y. Noise comes from hashes, so it is the same on any cluster."""

    def noise(name: str) -> Column:
        """About normal: six even numbers, centred."""
        even = [F.pmod(F.xxhash64("id", F.lit(f"{name}{i}{seed}")), F.lit(1 << 32)) / float(1 << 32) for i in range(6)]
        return (sum(even[1:], even[0]) - 3) * (2.0**0.5)

    rows = spark.range(n).withColumn("month", F.add_months(F.lit("2015-01-01").cast("date"), F.col("id").cast("int")))
    rows = rows.withColumns({"driver": noise("driver"), "season": F.sin(F.month("month") * 0.5235987755982988)})
    return rows.select("month", "driver", "season", (1.0 + effect * F.col("driver") + 0.5 * F.col("season") + 0.2 * noise("error")).alias("y"))
