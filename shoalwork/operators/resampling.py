"""Resampling by calendar blocks, penalized regressions on resampled months, and audits, from monthly sums of products.

Rows are summed by month once; a replicate is a sum over its months, so its cost does not grow with the rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index, season_terms
from .stats import complete, gram

PRIME = 2147483647  # 2**31 - 1


def drawn(seed: int, replicate: str, draw: str) -> Column:
    """A number under 2**31 - 1 that replicate and draw determine: two squarings modulo a prime, so draws are no even sequence."""
    first = (F.col(replicate).cast("long") * 48271 + F.col(draw).cast("long") * 69621 + seed * 40692 + 12345) % PRIME
    second = (first * first + 1442695) % PRIME
    return (second * second + first) % PRIME


def month_blocks(months: DataFrame, block: int, replicates: int, seed: int = 0, month: str = "month") -> DataFrame:
    """For each replicate the months drawn, as runs of `block` months, with repeats: replicate, draw, mi.

    As many runs as cover the calendar; a replicate is the same on any cluster.
    """
    span = months.agg(F.min(month_index(F.col(month))).alias("_a"), F.max(month_index(F.col(month))).alias("_b"))
    draws = F.ceil((F.col("_b") - F.col("_a") + 1) / block).cast("int")
    plan = span.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), draws - 1)))
    start = F.col("_a") + drawn(seed, "replicate", "draw") % F.greatest(F.col("_b") - F.col("_a") + 2 - block, F.lit(1))
    return plan.withColumn("mi", F.explode(F.sequence(start, start + block - 1))).select("replicate", "draw", F.col("mi").cast("int").alias("mi"))


def _resampled(df: DataFrame, sums: dict[str, Column], block: int, replicates: int, seed: int, month: str) -> DataFrame:
    """Sums over the months of each replicate; the months' own sums are one row for each month of the calendar."""
    monthly = df.groupBy(month_index(F.col(month)).alias("mi")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    plan = month_blocks(df, block, replicates, seed, month)
    return plan.join(F.broadcast(monthly), "mi").groupBy("replicate").agg(*(F.sum(n).alias(n) for n in sums))


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Replicates, mean, standard error, 95 % interval and share above zero."""
    v = F.col(value)
    return df.groupBy(*(keys or [])).agg(F.count(v).alias("replicates"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_error"), F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high"), F.avg((v > 0).cast("double")).alias("share_positive"))


def bootstrap_mean(df: DataFrame, value: str, block: int, replicates: int, seed: int = 0, month: str = "month") -> DataFrame:
    """Mean and its 95 % interval."""
    reps = _resampled(df, {"_s": F.col(value), "_n": F.col(value).isNotNull().cast("long")}, block, replicates, seed, month)
    return summary(reps.select("replicate", F.try_divide("_s", F.col("_n").cast("double")).alias("m")), "m").drop("share_positive")


def products(y: str, xs: list[str], weight: str | None = None) -> dict[str, Column]:
    """Products of (1, xs, y) with one another by names p0_0, p0_1 ..."""
    columns = [F.lit(1.0), *(F.col(x).cast("double") for x in [*xs, y])]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return {f"p{i}_{j}": w * columns[i] * columns[j] for i, j in itertools.combinations_with_replacement(range(len(columns)), 2)}


def _matrices(rows: pd.DataFrame, k: int, prefix: str = "p") -> np.ndarray:
    g = np.zeros((len(rows), k, k))
    for i, j in itertools.combinations_with_replacement(range(k), 2):
        g[:, i, j] = g[:, j, i] = rows[f"{prefix}{i}_{j}"]
    return g


def bootstrap_coefficients(df: DataFrame, y: str, xs: list[str], block: int, replicates: int, weight: str | None = None, seed: int = 0, month: str = "month") -> DataFrame:
    """The coefficients of every replicate's own regression: replicate, term, estimate (see summary)."""
    reps = _resampled(complete(df, [y, *xs, *([weight] if weight else [])]), products(y, xs, weight), block, replicates, seed, month)
    k, terms = len(xs) + 1, ["one", *xs]

    def solve(batches):
        for rows in batches:
            out = []
            for replicate, g in zip(rows["replicate"], _matrices(rows, k + 1)):
                beta = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
                out += [(replicate, t, float(b)) for t, b in zip(terms, beta)]
            yield pd.DataFrame(out, columns=["replicate", "term", "estimate"])

    return reps.mapInPandas(solve, "replicate int, term string, estimate double")


def bootstrap_rmse_difference(df: DataFrame, error_a: str, error_b: str, block: int, replicates: int, seed: int = 0, month: str = "month") -> DataFrame:
    """How much larger the RMSE of a is than that of b on the same months: observed, and mean and interval over replicates."""
    both = complete(df, [error_a, error_b])
    a, b = F.col(error_a).cast("double"), F.col(error_b).cast("double")
    sums = {"_a": a * a, "_b": b * b, "_n": F.lit(1.0)}
    difference = F.sqrt(F.col("_a") / F.col("_n")) - F.sqrt(F.col("_b") / F.col("_n"))
    whole = both.agg(*(F.sum(c).alias(n) for n, c in sums.items())).select(difference.alias("observed"))
    reps = _resampled(both, sums, block, replicates, seed, month).select("replicate", difference.alias("d"))
    return whole.join(F.broadcast(summary(reps, "d")))  # one row each


# --- penalized regression ---------------------------------------------------

def net_from_products(g: np.ndarray, penalty: float, ratio: float, rounds: int = 500) -> np.ndarray:
    """Coefficients of an elastic net on standardized columns by coordinate descent, in the columns' own units; the constant first."""
    n, k = g[0, 0], len(g) - 2
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale = np.where(sd > 0, sd, 1.0)
    a, c, b = cov[:k, :k] / np.outer(scale, scale), cov[:k, k] / scale, np.zeros(k)
    for _ in range(rounds):
        before = b.copy()
        for j in np.flatnonzero(sd > 0):
            rest = c[j] - a[j] @ b + a[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - penalty * ratio, 0) / (a[j, j] + penalty * (1 - ratio))
        if np.abs(b - before).max(initial=0) < 1e-10:
            break
    b = b / scale
    return np.concatenate(([mean[k] - mean[:k] @ b], b))


def stability_selection(df: DataFrame, y: str, xs: list[str], penalty: float, ratio: float, block: int, replicates: int, seed: int = 0, month: str = "month") -> DataFrame:
    """How often an elastic net on resampled months keeps each term, and the mean of its coefficients: term, frequency, mean."""
    reps = _resampled(complete(df, [y, *xs]), products(y, xs), block, replicates, seed, month)

    def fit(batches):
        for rows in batches:
            out = [(t, float(b)) for g in _matrices(rows, len(xs) + 2) for t, b in zip(xs, net_from_products(g, penalty, ratio)[1:])]
            yield pd.DataFrame(out, columns=["term", "estimate"])

    return reps.mapInPandas(fit, "term string, estimate double").groupBy("term").agg(F.avg((F.abs("estimate") > 1e-12).cast("double")).alias("frequency"), F.avg("estimate").alias("mean"))


def net_path(df: DataFrame, y: str, xs: list[str], penalties: list[float], ratios: list[float], least_months: int = 24, month: str = "month") -> DataFrame:
    """The error of every penalty and ratio one month ahead, over all origins with least_months months behind them: penalty, ratio, n, rmse.

    Only months' sums are put in order (one row for each month of the calendar).
    """
    sums = products(y, xs)
    monthly = complete(df, [y, *xs]).groupBy(month_index(F.col(month)).alias("mi")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    order = Window.orderBy("mi")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    folds = monthly.select("mi", F.count("*").over(behind).alias("_months"), *(F.col(n).alias(f"q{n[1:]}") for n in sums), *(F.sum(n).over(behind).alias(n) for n in sums)).filter(F.col("_months") >= least_months)
    k = len(xs) + 2

    def fit(batches):
        for rows in batches:
            out = []
            for g, q in zip(_matrices(rows, k), _matrices(rows, k, "q")):
                for p, r in itertools.product(penalties, ratios):
                    e = np.append(-net_from_products(g, p, r), 1.0)
                    out.append((p, r, float(q[0, 0]), float(max(0.0, e @ q @ e))))
            yield pd.DataFrame(out, columns=["penalty", "ratio", "n", "sse"])

    got = folds.mapInPandas(fit, "penalty double, ratio double, n double, sse double")
    return got.groupBy("penalty", "ratio").agg(F.sum("n").cast("long").alias("n"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


# --- audits -----------------------------------------------------------------

def explained(g: np.ndarray, by: list[int], target: int) -> float:
    """Share of a column's variance that others explain, from sums of products (column 0: ones)."""
    keep = [0, *by]
    total = g[target, target] - g[0, target] ** 2 / g[0, 0]
    if total <= 1e-12 * max(1.0, g[target, target]):
        return float("nan")
    beta = np.linalg.lstsq(g[np.ix_(keep, keep)], g[keep, target], rcond=None)[0]
    return float((beta @ g[keep, target] - g[0, target] ** 2 / g[0, 0]) / total)


def identifiability(df: DataFrame, drivers: list[str], harmonics: int = 2, month: str = "month") -> DataFrame:
    """How much of each driver is season and trend: driver, r2_season, r2_trend, r2_both and anomaly_share (what is left). One pass for all."""
    terms = season_terms(F.col(month), harmonics)
    rows = df.select(*drivers, *(c.alias(f"_{n}") for n, c in terms.items()), (month_index(F.col(month)) / 12.0 - 2000).alias("_trend"))
    season, k = [f"_{n}" for n in terms], len(terms)
    g, names, _ = gram(rows, drivers[-1], [*season, "_trend", *drivers[:-1]])
    out = []
    for d in drivers:
        at = names.index(d)
        s, t, both = (explained(g, by, at) for by in (list(range(1, k + 1)), [k + 1], list(range(1, k + 2))))
        out.append((d, s, t, both, 1 - both))
    return df.sparkSession.createDataFrame(out, "driver string, r2_season double, r2_trend double, r2_both double, anomaly_share double")
