"""Regression and inference. One Spark pass gathers sums of products; the algebra is on matrices of a few columns."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index
from ..plans.storage import delete, materialize


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite value in every column."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")))
    return df


def gram(df: DataFrame, y: str, xs: list[str], weight: str | None = None) -> tuple[np.ndarray, list[str], int]:
    """Weighted products of (1, xs, y) with one another, over complete rows; one aggregate whatever the size."""
    df = complete(df, [y, *xs, *([weight] if weight else [])])
    names = ["one", *xs, y]
    col = lambda n: F.lit(1.0) if n == "one" else F.col(n).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    row = df.agg(F.count("*").alias("n"), *(F.sum(w * col(names[i]) * col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(names), len(names)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"p{i}_{j}"] or 0.0
    return g, names, row["n"]


def solve(g: np.ndarray, keep: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the columns `keep` for the last one, and R squared about its mean."""
    k = np.array(keep)
    beta = np.linalg.lstsq(g[np.ix_(k, k)], g[k, -1], rcond=None)[0]
    total = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    return beta, float((beta @ g[k, -1] - g[0, -1] ** 2 / g[0, 0]) / total) if total > 0 else float("nan")


def ols(df: DataFrame, y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """Coefficients with standard errors, t statistics and R squared."""
    g, names, n = gram(df, y, xs, weight)
    keep = list(range(len(names) - 1))
    beta, r2 = solve(g, keep)
    k = np.array(keep)
    rss = max(0.0, float(g[-1, -1] - beta @ g[k, -1]))
    cov = np.linalg.pinv(g[np.ix_(k, k)]) * rss / max(1, n - len(keep))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rows = [(names[i], float(b), float(s), float(b / s) if s else None, r2, n) for i, b, s in zip(keep, beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t double, r2 double, n long")


def drop_one_r2(df: DataFrame, y: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """What R squared loses without each term."""
    g, names, _ = gram(df, y, xs, weight)
    full = solve(g, list(range(len(xs) + 1)))[1]
    rows = [(x, full - solve(g, [i for i in range(len(xs) + 1) if i != k])[1], full) for k, x in enumerate(xs, 1)]
    return df.sparkSession.createDataFrame(rows, "term string, semi_partial_r2 double, full_r2 double")


def shapley_r2(df: DataFrame, y: str, groups: dict[str, list[str]], weight: str | None = None) -> DataFrame:
    """Exact Shapley shares of R squared over groups of terms, from one matrix; at most 14 groups."""
    if len(groups) > 14:
        raise ValueError("at most 14 groups")
    xs = [x for g in groups.values() for x in g]
    m, _, _ = gram(df, y, xs, weight)
    place = {x: i for i, x in enumerate(xs, 1)}
    members = [[place[x] for x in g] for g in groups.values()]
    value = {s: solve(m, [0, *(i for k in s for i in members[k])])[1] if s else 0.0 for r in range(len(groups) + 1) for s in itertools.combinations(range(len(groups)), r)}
    n, out = len(groups), []
    for k, name in enumerate(groups):
        share = sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[tuple(sorted((*s, k)))] - value[s]) for s in value if k not in s)
        out.append((name, share, value[tuple(range(n))]))
    return df.sparkSession.createDataFrame(out, "term string, shapley_r2 double, full_r2 double")


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    g, _, n = gram(df, xs[0], xs[1:])
    order = [len(xs), *range(1, len(xs))]
    mean = g[0, order] / g[0, 0]
    cov = g[np.ix_(order, order)] / g[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    inv = np.linalg.pinv(cov / np.outer(sd, sd))
    return df.sparkSession.createDataFrame([(x, float(inv[i, i])) for i, x in enumerate(xs)], "term string, vif double")


def hac(df: DataFrame, y: str, xs: list[str], lags: int, month: str = "month") -> DataFrame:
    """OLS with Newey-West errors whose lags are calendar months: only pairs exactly h months apart count."""
    g, names, n = gram(df, y, xs)
    k = len(xs) + 1
    beta, _ = solve(g, list(range(k)))
    rows = complete(df, [y, *xs]).withColumn("mi", month_index(F.col(month)))
    fit = sum((float(b) * F.col(x) for b, x in zip(beta[1:], xs)), F.lit(float(beta[0])))
    e = rows.select("mi", (F.col(y) - fit).alias("_e"), *xs)
    score = e.select("mi", *((F.col("_e") * (F.lit(1.0) if i == 0 else F.col(xs[i - 1]))).alias(f"s{i}") for i in range(k)))
    per_month = score.groupBy("mi").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
    own = score.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(k))).first()
    meat = np.array([[own[f"p{i}_{j}"] for j in range(k)] for i in range(k)], float)
    shifted = per_month.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select((F.col("mi") + F.col("lag")).alias("mi"), "lag", *(F.col(f"s{i}").alias(f"b{i}") for i in range(k)))
    cross = per_month.join(shifted, "mi").groupBy("lag").agg(*(F.sum(F.col(f"s{i}") * F.col(f"b{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(k))).collect()  # one row per lag
    for r in cross:
        m = np.array([[r[f"p{i}_{j}"] for j in range(k)] for i in range(k)], float)
        meat += (1 - r["lag"] / (lags + 1)) * (m + m.T)
    bread = np.linalg.pinv(g[:k, :k])
    cov = bread @ meat @ bread * n / max(1, n - k)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return df.sparkSession.createDataFrame([(names[i], float(beta[i]), float(se[i])) for i in range(k)], "term string, estimate double, std_error double")


def bh_fdr(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """Benjamini-Hochberg q-values within each key; null p stay null and do not count."""
    ok = df.filter(F.col(p).isNotNull())
    up = Window.partitionBy(*keys).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*keys))
    raw = ok.withColumn("_raw", F.col(p) * m / F.count("*").over(up.rangeBetween(Window.unboundedPreceding, 0)))
    q = raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(Window.partitionBy(*keys).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("_raw")
    return q.unionByName(df.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def aicc(log_likelihood: float, k: int, n: int) -> float:
    """Corrected information criterion; infinite where the correction is undefined."""
    return 2 * k - 2 * log_likelihood + (2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf)


def gaussian_llf(rss: float, n: int) -> float:
    return -n / 2 * (math.log(2 * math.pi * rss / n) + 1)


def ar_roots(coefficients: list[float]) -> list[float]:
    """Moduli of the roots of an autoregression's companion matrix; all under one: stable."""
    p = len(coefficients)
    if not p:
        return []
    companion = np.zeros((p, p))
    companion[0], companion[1:, :-1] = coefficients, np.eye(p - 1)
    return sorted((float(abs(r)) for r in np.linalg.eigvals(companion)), reverse=True)


def turned(place: np.ndarray, z: np.ndarray, weight: np.ndarray) -> int:
    """How many pairs (by weight) have a lower place and no lower z: blocks are merged two at a time, all of one width at once, n log n."""
    rank = np.unique(z, return_inverse=True)[1]
    order = np.lexsort((rank, place))  # of one place by rank, so that only equal ranks count, which are taken off again
    place, rank, weight = place[order], rank[order], weight[order].astype(np.int64)
    n, count, width, top = len(place), 0, 1, int(rank.max()) + 2 if len(rank) else 1
    while width < n:
        block, left = np.arange(n) // (2 * width), (np.arange(n) // width) % 2 == 0
        keys = block * top + rank
        by_key = np.argsort(keys[left], kind="stable")
        ordered, upto = keys[left][by_key], np.concatenate(([0], np.cumsum(weight[left][by_key])))
        upper, below = np.searchsorted(ordered, (block[~left] + 1) * top), np.searchsorted(ordered, keys[~left])
        count += int(((upto[upper] - upto[below]) * weight[~left]).sum())
        width *= 2
    if n:
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (rank[1:] != rank[:-1]))))
        sums, squares = np.add.reduceat(weight, first), np.add.reduceat(weight * weight, first)
        count -= int(((sums * sums - squares) // 2).sum())
    return count


def slopes_up_to(x: np.ndarray, y: np.ndarray, slope: float) -> int:
    """How many pairs of points (no two alike in x counted) have at most this slope: those whose order turns or stays level when the points are put by y - slope * x."""
    return turned(x, y - slope * x, np.ones(len(x), np.int64))


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median of the slopes of all pairs of points whose x differ; NaN if there is none. Large inputs by bisection on the number of smaller slopes."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n, ties = len(x), np.unique(x, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum())
    if not pairs:
        return float("nan")
    if n <= 2000:
        i, j = np.triu_indices(n, 1)
        dx = x[j] - x[i]
        return float(np.median((y[j] - y[i])[dx != 0] / dx[dx != 0]))
    step = np.diff(x)
    most = float((np.ptp(y) + 1e-300) / step[step > 0].min())

    def smallest(rank: int) -> float:
        """The slope of that rank (from 1)."""
        low, high = -most, most
        while True:
            middle = (low + high) / 2
            if not low < middle < high:
                return high
            if slopes_up_to(x, y, middle) >= rank:
                high = middle
            else:
                low = middle

    return smallest((pairs + 1) // 2) if pairs % 2 else (smallest(pairs // 2) + smallest(pairs // 2 + 1)) / 2


AT_ONCE, BLOCK_ROWS, SLOPES = 50_000, 200_000, 12  # points fitted on the driver, at most; points of a block, about; slopes counted in a job


def count_slopes(blocks: DataFrame, n_blocks: int, slopes: list[float], sample: np.ndarray) -> list[int]:
    """For each slope how many pairs of points have at most that slope. blocks: x, y, w (how many points) and block, which rises with x and holds all points of an x.

    Pairs within a block are counted block by block. Those across blocks are told apart by buckets of z = y - slope * x: pairs of different buckets by a table of counts
    by block and bucket, pairs of one bucket bucket by bucket. Bounds of buckets are z of the sample; what equals a bound is a bucket of its own, so ties need no counting.
    """
    bounds = [np.unique(sample[:, 1] - s * sample[:, 0]) for s in slopes]
    kept = [b[np.unique(np.linspace(0, len(b) - 1, min(len(b), 2 * n_blocks)).astype(int))] for b in bounds]

    def bucketed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, (s, edges) in enumerate(zip(slopes, kept)):
                z = pdf.y.to_numpy() - s * pdf.x.to_numpy()
                at = np.searchsorted(edges, z)
                on = (at < len(edges)) & (edges[np.minimum(at, len(edges) - 1)] == z)
                yield pd.DataFrame({"k": k, "block": pdf.block, "x": pdf.x, "z": z, "w": pdf.w, "bucket": 2 * at + on})

    schema = "k int, block int, x double, z double, w long, bucket int"
    rows = blocks.select("block", "x", "y", "w").mapInPandas(bucketed, schema)
    within = blocks.groupBy("block").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a < b").select("block")  # a block of one x has no pairs

    def inside(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k, turned(pdf.x.to_numpy(), pdf.y.to_numpy() - s * pdf.x.to_numpy(), pdf.w.to_numpy())) for k, s in enumerate(slopes)], columns=["k", "n"])

    def across(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], turned(pdf.block.to_numpy(), pdf.z.to_numpy(), pdf.w.to_numpy()))], columns=["k", "n"])

    own = blocks.join(within, "block", "left_semi").groupBy("block").applyInPandas(inside, "k int, n long")
    met = rows.filter("bucket % 2 = 0").groupBy("k", "bucket").applyInPandas(across, "k int, n long")
    total = [0] * len(slopes)
    for r in own.unionByName(met).groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row for each slope
        total[r.k] += r.n
    table = [np.zeros((n_blocks, 2 * len(e) + 1), np.int64) for e in kept]
    for r in rows.groupBy("k", "block", "bucket").agg(F.sum("w").alias("w")).collect():  # blocks times about 4 * blocks
        table[r.k][r.block, r.bucket] += r.w
    for k, t in enumerate(table):
        before = np.vstack((np.zeros((1, t.shape[1]), np.int64), np.cumsum(t, 0)[:-1]))  # in lower blocks
        above = np.cumsum(before[:, ::-1], 1)[:, ::-1]
        total[k] += int((t * (above - before)).sum()) + int((t[:, 1::2] * before[:, 1::2]).sum())
    return total


def _slope_of_rank(count, rank: int, low: float, high: float, below: int, upto: int) -> tuple[float, int]:
    """The least slope that has so many pairs up to it, and how many: low has too few (below), high enough (upto)."""
    while True:
        gap = high - low
        share = (rank - below) / max(1, upto - below)
        near = [share + d for d in (-0.02, -0.002, 0.0, 0.002, 0.02)] if upto - below > 1000 else []  # where the count grows evenly; few pairs lie anywhere
        even = [(k + 1) / (SLOPES - len(near) + 1) for k in range(SLOPES - len(near))]
        guesses = sorted({g for g in (low + gap * v for v in near + even) if low < g < high})
        if not guesses:
            return high, upto
        for g, n in zip(guesses, count(guesses)):
            if n >= rank:
                high, upto = g, n
                break
            low, below = g, n


def distributed_median_slope(points: DataFrame, n_points: int) -> float:
    """The median slope of all pairs of points (x, y) whose x differ; NaN if there is none. Points that are alike are one with a weight."""
    spark = points.sparkSession
    n_blocks = max(2, -(-n_points // BLOCK_ROWS))
    weighted = points.groupBy("x", "y").agg(F.count("*").alias("w"))
    blocks = materialize(weighted.repartitionByRange(n_blocks, "x").withColumn("block", F.spark_partition_id()), "slope-points")  # n_blocks at most
    alike = blocks.groupBy("x").agg(F.sum("w").alias("n")).agg(F.sum(F.expr("CAST(n AS DECIMAL(38,0)) * (n - 1) / 2"))).first()[0]
    pairs = n_points * (n_points - 1) // 2 - int(alike)
    try:
        if not pairs:
            return float("nan")
        few = blocks.orderBy(F.xxhash64("x", "y")).limit(2000).collect()  # only to know where to look
        sample = np.array([(r.x, r.y) for r in few])
        i, j = np.triu_indices(len(sample), 1)
        dx = sample[j, 0] - sample[i, 0]
        seen = np.sort(((sample[j, 1] - sample[i, 1])[dx != 0] / dx[dx != 0])) if (dx != 0).any() else np.zeros(1)
        spread = blocks.agg(F.max("y").alias("a"), F.min("y").alias("b")).first()
        after = F.lead("x").over(Window.partitionBy("block").orderBy("x"))
        steps = blocks.select("block", "x").distinct().withColumn("_d", after - F.col("x")).agg(F.min("_d")).first()[0]
        edges = blocks.groupBy("block").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("block").collect()  # one row for each block
        steps = min([d for d in [steps, *(q.a - p.b for p, q in zip(edges, edges[1:]))] if d])
        most = (spread.a - spread.b + 1e-300) / steps
        count = lambda slopes: count_slopes(blocks, n_blocks, slopes, sample)

        def found(rank: int) -> tuple[float, int]:
            share = rank / pairs
            around = [float(np.quantile(seen, min(max(share + d, 0), 1))) for d in (-0.05, -0.01, 0.01, 0.05)]
            low, high, below, upto = -most * 2 - 1, most * 2 + 1, 0, pairs
            for g, n in zip(around, count(around)):
                if n < rank:
                    low, below = max(low, g), max(below, n)
                elif g < high:
                    high, upto = g, n
            return _slope_of_rank(count, rank, low, high, below, upto)

        value, upto = found((pairs + 1) // 2)
        if pairs % 2 or upto > pairs // 2:
            return value
        return (value + found(pairs // 2 + 1)[0]) / 2
    finally:
        delete(spark, blocks._table_path)


def exact_median(values: DataFrame, value: str, n: int) -> float:
    """The median of a column of n numbers: ranges are counted, and only those that hold the middle are put in order."""
    ranges = materialize(values.select(F.col(value).alias("v")).groupBy("v").agg(F.count("*").alias("w")).repartitionByRange(max(1, -(-n // BLOCK_ROWS)), "v").withColumn("part", F.spark_partition_id()), "median")
    sizes = ranges.groupBy("part").agg(F.sum("w").alias("w")).orderBy("part").collect()  # one row for each range
    out, wanted, before = [], {(n - 1) // 2, n // 2}, 0
    for r in sizes:
        here = [k - before for k in wanted if before <= k < before + r.w]
        if here:
            upto = F.sum("w").over(Window.orderBy("v"))
            part = ranges.filter(F.col("part") == r.part).withColumn("_upto", upto)
            out += [part.filter(F.col("_upto") > k).agg(F.min("v")).first()[0] for k in here]
        before += r.w
    delete(values.sparkSession, ranges._table_path)
    return sum(out) / len(out) if out else float("nan")


def theil_sen(df: DataFrame, x: str, y: str, most: int | None = None) -> DataFrame:
    """The median slope over all pairs of rows, the median intercept, and the number of rows: slope, intercept, n.

    Rows without a finite value in both are passed over. All rows count; most, if given, is the number of rows, in the order of a hash, that it is fitted on. Up to
    50,000 rows are fitted at once; more stay where they are, and the slope is found by counting the pairs of smaller slope again and again,
    so that no task holds more than a block of rows (or of ties).
    """
    rows = complete(df, [x, y]).select((F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))
    if most is not None:
        rows = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(most)
    few = rows.limit(AT_ONCE + 1).collect()
    if len(few) <= AT_ONCE:
        pts = np.array([(r.x, r.y) for r in few]).reshape(-1, 2)
        slope, n = median_slope(pts[:, 0], pts[:, 1]), len(pts)
        level = float(np.median(pts[:, 1] - slope * pts[:, 0])) if n else float("nan")
    else:
        n = rows.count()
        slope = distributed_median_slope(rows, n)
        level = exact_median(rows.select((F.col("y") - F.lit(slope) * F.col("x")).alias("e")), "e", n) if slope == slope else float("nan")
    return df.sparkSession.createDataFrame([(slope, level, n)], "slope double, intercept double, n long")


def coefficient_table(table: DataFrame, level: float = 0.95, drop: tuple[str, ...] = ("one",)) -> DataFrame:
    """Coefficients with intervals, two-sided p and q (false discovery rate over the table) of a table with term, estimate and std_error.

    For large samples: the normal distribution. Ordered by a table of terms, so small.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    rows = [(r.term, r.estimate, r.std_error) for r in table.filter(~F.col("term").isin(*drop)).select("term", "estimate", "std_error").collect()]  # one row per term
    out = []
    for term, b, se in rows:
        p = math.erfc(abs(b / se) / math.sqrt(2)) if se else None
        out.append((term, b, se, b - z * se if se is not None else None, b + z * se if se is not None else None, b / se if se else None, p))
    made = table.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, low double, high double, t double, p double")
    return bh_fdr(made.withColumn("_all", F.lit(0)), "p", ["_all"]).drop("_all")


def mean_test(df: DataFrame, value: str, lags: int, month: str = "month") -> DataFrame:
    """Whether a monthly mean differs from zero, with Newey-West errors on calendar lags (paired losses, say)."""
    out = hac(df.withColumnRenamed(value, "_v"), "_v", [], lags, month)
    return out.select("estimate", "std_error", F.try_divide("estimate", F.nullif("std_error", F.lit(0.0))).alias("t"))
