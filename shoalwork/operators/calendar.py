"""Series on the calendar: a gap stays a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index


def densify(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """A row for every month between each key's first and last; nulls for gaps.

    Every row stands for itself and for the missing months up to the next one, so the table is read once and not
    joined to a calendar.
    """
    after = F.lead(month).over(Window.partitionBy(*keys).orderBy(month))
    until = F.greatest(F.col(month), F.coalesce(F.add_months(after, -1), F.col(month)))
    rows = df.withColumn("_until", until).withColumn("_month", F.explode(F.sequence(F.col(month).cast("date"), F.col("_until").cast("date"), F.expr("interval 1 month"))))
    own = F.col("_month") == F.col(month)
    return rows.select(*keys, F.col("_month").alias(month), *(F.when(own, F.col(c)).alias(c) for c in df.columns if c not in (*keys, month)))


def calendar_lag(df: DataFrame, keys: list[str], columns: list[str], months: int = 1, month: str = "month", suffix: str | None = None) -> DataFrame:
    """Values of exactly so many months before; null if that month is missing."""
    w = Window.partitionBy(*keys).orderBy("_mi").rangeBetween(-months, -months)
    out = df.withColumn("_mi", month_index(F.col(month)))
    for c in columns:
        out = out.withColumn(f"{c}{suffix or f'_lag{months}'}", F.first(c).over(w))
    return out.drop("_mi")


def positional_lag(df: DataFrame, keys: list[str], columns: list[str], rows: int = 1, month: str = "month", suffix: str | None = None) -> DataFrame:
    """Values of the observation so many rows before, however long ago."""
    w = Window.partitionBy(*keys).orderBy(month)
    for c in columns:
        df = df.withColumn(f"{c}{suffix or f'_prev{rows}'}", F.lag(c, rows).over(w))
    return df


def gaps(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Every row with the months to the next one missing after it (0: none; null: last row)."""
    after = F.lead(month_index(F.col(month))).over(Window.partitionBy(*keys).orderBy(month))
    return df.withColumn("missing_after", after - month_index(F.col(month)) - 1)


def gap_report(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """For each key: rows, span in months, and rows whose previous month is missing (the first not counted)."""
    mi = month_index(F.col(month))
    before = F.lag(mi).over(Window.partitionBy(*keys).orderBy(month))
    return (
        df.withColumn("_mi", mi).withColumn("_before", before).groupBy(*keys)
        .agg(F.count("*").alias("n_rows"), (F.max("_mi") - F.min("_mi") + 1).alias("span_months"), F.count_if(F.col("_before") != F.col("_mi") - 1).alias("n_after_gap"))
    )


def runs(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Unbroken runs of months: first, last and length."""
    mi = month_index(F.col(month))
    island = mi - F.row_number().over(Window.partitionBy(*keys).orderBy(month))
    return df.select(*keys, month, island.alias("_island")).groupBy(*keys, "_island").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count("*").alias("n_months")).drop("_island")


def missing_months(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """The months between a key's first and last that have no row."""
    have = df.select(*keys, month).distinct()
    return densify(have, keys, month).select(*keys, month).join(have, [*keys, month], "left_anti")


def gap_spans(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Runs of missing months, longest first within each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n_months"), "first_month")
    return runs(missing_months(df, keys, month), keys, month).withColumn("gap_rank", F.row_number().over(order))


def bridges(df: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """The two ends of every gap: months and values on either side."""
    w = Window.partitionBy(*keys).orderBy(month)
    rows = df.select(*keys, month, value, F.lead(month).over(w).alias("to_month"), F.lead(value).over(w).alias("to_value"))
    return rows.filter(month_index(F.col("to_month")) - month_index(F.col(month)) > 1).withColumnsRenamed({month: "from_month", value: "from_value"})


def segments(df: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """Numbers the unbroken stretches of each series, from 0; a series starts anew after a gap."""
    w = Window.partitionBy(*keys).orderBy(month)
    mi = month_index(F.col(month))
    breaks = F.coalesce((mi - F.lag(mi).over(w) > 1).cast("int"), F.lit(0))
    return df.withColumn("_b", breaks).withColumn("segment", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("starts", (F.lag(mi).over(w).isNull() | (F.col("_b") == 1))).drop("_b")


def monthly_counts(df: DataFrame, keys: list[str], when: Column) -> DataFrame:
    """Rows of each key in every month of its span; zero where there is none."""
    counts = df.withColumn("month", F.trunc(when, "MM")).filter("month is not null").groupBy(*keys, "month").count()
    return densify(counts, keys).withColumn("n", F.coalesce("count", F.lit(0))).drop("count")


def seasonal_naive(df: DataFrame, keys: list[str], value: str, month: str = "month") -> DataFrame:
    """The value of exactly twelve months before, and whether there is one."""
    out = calendar_lag(df, keys, [value], 12, month, "_year_ago")
    return out.withColumn("available", F.col(f"{value}_year_ago").isNotNull())


def rolling_origins(months: DataFrame, horizon: int = 3, least_training: int = 24, folds: int = 8, month: str = "month") -> DataFrame:
    """Test windows of `horizon` months that end at the series' end: fold, train_to, test_from, test_to, n_train, n_test, used.

    Counted back from the last month, as long as a window begins after the first; a fold with fewer than least_training
    months before it, or none in it, is kept in the audit as unused. The months are a calendar's, so this table is small at any scale.
    """
    mi = months.select(month_index(F.col(month)).alias("mi")).distinct()
    last = mi.agg(F.max("mi").alias("_last"), F.min("mi").alias("_first"))
    back = (folds - F.col("fold") + 1) * horizon
    plan = last.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).filter(F.col("_last") - back + 1 > F.col("_first"))
    left_out = F.greatest(F.lit(0), folds - F.floor((F.col("_last") - F.col("_first")) / horizon)).cast("int")
    plan = plan.select((F.col("fold") - left_out).alias("fold"), (F.col("_last") - back).alias("train_to"), (F.col("_last") - back + 1).alias("test_from"), (F.col("_last") - back + horizon).alias("test_to"))
    seen = plan.join(mi, F.col("mi") <= F.col("test_to")).groupBy("fold", "train_to", "test_from", "test_to").agg(F.count_if(F.col("mi") <= F.col("train_to")).alias("n_train"), F.count_if(F.col("mi") >= F.col("test_from")).alias("n_test"))
    return seen.withColumn("used", (F.col("n_train") >= least_training) & (F.col("n_test") > 0))
