"""Observations over time: lookback statistics, nearest matches, composites and rolling medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import enough, variation


def lookback(df: DataFrame, keys: list[str], day: str, value: str, days: int = 90, least: int = 3, ddof: int = 1, floor: float = 1e-6) -> DataFrame:
    """Count, mean, deviation and variation over the `days` days that end with each observation's own day."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)
    std = (F.stddev_samp if ddof else F.stddev_pop)(value).over(w)
    out = df.withColumns({"n_obs": F.count(value).over(w), "_mean": F.avg(value).over(w), "_std": std})
    return out.select(*df.columns, "n_obs", enough(F.col("_mean"), F.col("n_obs"), least).alias("mean"), enough(F.col("_std"), F.col("n_obs"), least).alias("std"), enough(variation(F.col("_std"), F.col("_mean"), floor), F.col("n_obs"), least).alias("cv"))


def members(targets: DataFrame, candidates: DataFrame, keys: list[str], days: int = 90, end: str = "end_date") -> DataFrame:
    """Candidates whose end lies in [target end - days, target end), by key.

    A bucket of `days` days is the equi-join key, so each target meets two buckets and nothing is compared with all.
    """
    t = targets.select(*keys, F.col(end).alias("target_end")).withColumn("_b", F.explode(F.array(F.floor((F.unix_date("target_end") - 1) / days), F.floor((F.unix_date("target_end") - days) / days)))).distinct()
    c = candidates.withColumn("_b", F.floor(F.unix_date(F.col(end)) / days))
    d = F.datediff("target_end", end)
    return c.join(t, [*keys, "_b"]).filter((d > 0) & (d <= days)).drop("_b")


def nearest(points: DataFrame, scenes: DataFrame, keys: list[str], point_id: str, day: str, start: str, end: str, scene_id: str, tolerance: int) -> DataFrame:
    """For each point the scene whose midpoint is nearest among those that, widened by the tolerance, hold its day.

    Ties: earlier start, then id. Points without one are left out. Of scenes of one period the least id counts, and each key's distinct
    days are matched, not its points. Buckets of days carry that join; periods are exploded into the buckets they span, so short
    ones cost one or two rows each.
    """
    width = max(1, 2 * tolerance)
    s = scenes.groupBy(*keys, F.col(start).alias("_s"), F.coalesce(end, start).alias("_e")).agg(F.min(F.struct(F.col(scene_id).alias("scene"))).alias("_m")).select(*keys, "_s", "_e", "_m.scene")
    s = s.withColumn("_b", F.explode(F.sequence(F.floor((F.unix_date("_s") - tolerance) / width), F.floor((F.unix_date("_e") + tolerance) / width))))
    d = F.unix_date("_day")
    days = points.select(*keys, F.col(day).alias("_day")).distinct().withColumn("_b", F.floor(d / width))
    near = days.join(s, [*keys, "_b"]).filter((d >= F.unix_date("_s") - tolerance) & (d <= F.unix_date("_e") + tolerance))
    off = F.abs(d - (F.unix_date("_s") + F.unix_date("_e")) / 2)
    best = near.groupBy(*keys, "_day").agg(F.min(F.struct(off.alias("days_off"), "_s", "scene")).alias("_m")).select(*keys, F.col("_day").alias(day), "_m.*")
    order = Window.partitionBy(*keys, point_id).orderBy("days_off", "_s", "scene")
    return points.join(best, list(dict.fromkeys([*keys, day]))).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*points.columns, "scene", "days_off")


def sample(points: DataFrame, pixels: DataFrame, at: list[str], value: str, missing: int = 255) -> DataFrame:
    """The pixel value at each point's place; `missing` outside."""
    return points.join(pixels.select(*at, F.col(value).alias("sampled")), at, "left").withColumn("sampled", F.coalesce("sampled", F.lit(missing)))


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def point_stability(df: DataFrame, point: str, day: str, value: str, floating: Column, last: int | None = None) -> DataFrame:
    """Deviation and variation of each point's (last) observations, and the distinct months in which it floats."""
    rows = last_rows(df, [point], day, last) if last else df
    return rows.groupBy(point).agg(F.count(value).alias("n_obs"), F.stddev_samp(value).alias("std"), variation(F.stddev_samp(value), F.avg(value)).alias("cv"), F.countDistinct(F.when(floating, F.trunc(day, "MM"))).alias("n_months_floating"))


def percentile_composite(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """An exact percentile of each key's values."""
    return df.groupBy(*keys).agg(F.percentile(value, q).alias(out))


def median_composite(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Medians of several bands by pixel and day."""
    return df.groupBy(*keys).agg(*(F.median(v).alias(v) for v in values))


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, width: int, least: int = 1, out: str = "rolling_median") -> DataFrame:
    """Centred median of `width` rows where at least `least` have a value."""
    before = width // 2
    frame = f"over (partition by {', '.join(keys)} order by {order} rows between {before} preceding and {width - before - 1} following)"
    return df.withColumn(out, F.expr(f"case when count({value}) {frame} >= {least} then percentile({value}, 0.5) {frame} end"))


def wet_days(df: DataFrame, keys: list[str], rain: str, wet: float = 1.0, spike: float = 20.0) -> DataFrame:
    """Monthly totals, largest day, wet days, spikes, and the total by wet day (0 without one)."""
    n = F.count_if(F.col(rain) >= wet)
    return df.groupBy(*keys).agg(F.sum(rain).alias("total"), F.max(rain).alias("largest_day"), n.alias("wet_days"), F.count_if(F.col(rain) >= spike).alias("spikes"), F.coalesce(F.try_divide(F.sum(rain), F.nullif(n, F.lit(0)).cast("double")), F.lit(0.0)).alias("intensity"))


def ddof_check(df: DataFrame, keys: list[str], day: str, value: str, reference: str, days: int, least: int = 3) -> DataFrame:
    """Which deviation a reference follows: for sample and population deviations over the last `days` days the pairs, bias and RMSE against it, and the nearer one chosen."""
    out = None
    for ddof in (0, 1):
        got = lookback(df.select(*keys, day, value, reference), keys, day, value, days, least, ddof=ddof)
        d = F.col("std") - F.col(reference)
        row = got.agg(F.lit(ddof).alias("ddof"), F.count(d).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.min_by("ddof", F.struct("rmse", "ddof")).alias("_best"))  # of two rows
    return out.join(F.broadcast(best)).withColumn("chosen", F.col("ddof") == F.col("_best")).drop("_best")


def support_agreement(df: DataFrame, keys: list[str], count: str, reference: str, least: int = 3) -> DataFrame:
    """Whether enough observations and a value in the reference go together: both, only_local, only_reference, neither, and the share that agrees."""
    local, other = F.coalesce(F.col(count) >= least, F.lit(False)), F.col(reference).isNotNull()
    both, neither = F.count_if(local & other), F.count_if(~local & ~other)
    return df.groupBy(*keys).agg(both.alias("both"), F.count_if(local & ~other).alias("only_local"), F.count_if(~local & other).alias("only_reference"), neither.alias("neither"), ((both + neither) / F.count("*")).alias("agreement"))


def tail_agreement(df: DataFrame, keys: list[str], local: str, reference: str, cuts: list[float]) -> DataFrame:
    """How many values lie above each cut on either side and on both: keys, cut, n_local, n_reference, n_both."""
    rows = df.withColumn("cut", F.explode(F.array(*(F.lit(float(c)) for c in cuts))))
    a, b = F.coalesce(F.col(local) > F.col("cut"), F.lit(False)), F.coalesce(F.col(reference) > F.col("cut"), F.lit(False))
    return rows.groupBy(*keys, "cut").agg(F.count_if(a).alias("n_local"), F.count_if(b).alias("n_reference"), F.count_if(a & b).alias("n_both"))
