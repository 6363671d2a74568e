"""Agreement, skill, correlation and decomposition statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, month_index, ratio, safe_corr


# --- confusion ------------------------------------------------------------

def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Dense counts of truth by prediction and each cell's share of its row."""
    spark = df.sparkSession
    code = F.explode(F.array(*map(F.lit, classes)))
    grid = df.select(*keys).distinct().withColumn("truth", code).withColumn("predicted", code) if keys else spark.range(1).select(code.alias("truth")).withColumn("predicted", code)
    counts = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).count()
    out = grid.join(counts, [*keys, "truth", "predicted"], "left").withColumn("n", F.coalesce("count", F.lit(0))).drop("count")
    return out.withColumn("row_share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys, "truth"))))


def agreement(df: DataFrame, keys: list[str], a: str, b: str, classes: list[int], target: int) -> DataFrame:
    """Overall agreement, kappa, and the target's Jaccard and Dice indices of two classifications."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    aggs = [F.count_if(ok).alias("n"), F.count_if(ok & (F.col(a) == F.col(b))).alias("n_same")]
    aggs += [F.count_if(ok & (F.col(a) == c)).alias(f"_a{c}") for c in classes] + [F.count_if(ok & (F.col(b) == c)).alias(f"_b{c}") for c in classes]
    aggs += [F.count_if(ok & (F.col(a) == target) & (F.col(b) == target)).alias("n_both"), F.count_if(ok & ((F.col(a) == target) | (F.col(b) == target))).alias("n_either")]
    out = df.groupBy(*keys).agg(*aggs).withColumn("agreement", ratio(F.col("n_same"), F.col("n")))
    chance = sum((F.col(f"_a{c}") * F.col(f"_b{c}").cast("double") for c in classes), F.lit(0.0)) / F.nullif(F.col("n") * F.col("n").cast("double"), F.lit(0.0))
    kappa = F.when(F.abs(1 - chance) > 1e-12, (F.col("agreement") - chance) / (1 - chance))
    dice = F.try_divide(2.0 * F.col("n_both"), F.col("n_either") + F.col("n_both"))
    return out.select(*keys, "n", "agreement", kappa.alias("kappa"), ratio(F.col("n_both"), F.col("n_either")).alias("jaccard"), dice.alias("dice"))


def per_class(df: DataFrame, keys: list[str], truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Precision, recall, F1 and support of every class; zero where undefined."""
    counts = df.groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in classes for n, f in (
        ("tp", lambda c: F.count_if((F.col(truth) == c) & (F.col(predicted) == c))), ("p", lambda c: F.count_if(F.col(predicted) == c)), ("s", lambda c: F.count_if(F.col(truth) == c)))))
    rows = counts.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"_tp{c}").alias("tp"), F.col(f"_p{c}").alias("p"), F.col(f"_s{c}").alias("support")) for c in classes))).alias("_c")).select(*keys, "_c.*")
    zero = F.lit(0.0)
    rows = rows.withColumn("precision", F.coalesce(ratio(F.col("tp"), F.col("p")), zero)).withColumn("recall", F.coalesce(ratio(F.col("tp"), F.col("support")), zero))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), zero)), zero)).drop("tp", "p")


def metric_suite(df: DataFrame, keys: list[str], truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Accuracy, balanced accuracy, kappa, and macro and weighted F1."""
    each = per_class(df, keys, truth, predicted, classes)
    macro = each.groupBy(*keys).agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    whole = agreement(df, keys, truth, predicted, classes, classes[0]).select(*keys, "n", F.col("agreement").alias("accuracy"), "kappa")
    return whole.join(macro, keys) if keys else whole.crossJoin(macro)


def strata(df: DataFrame, bins: list[str], label: str, truth: str, predicted: str, target: int) -> DataFrame:
    """Precision and recall of the target within every bin; bins without a row stay, with zero support."""
    names = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(bins)], f"bin_order int, {label} string")
    t, p = F.col(truth) == target, F.col(predicted) == target
    got = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(t).alias("support"), F.count_if(p).alias("n_predicted"))
    out = F.broadcast(names).join(got, label, "left")
    return out.select("bin_order", label, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "support", "n_predicted")), ratio(F.col("tp"), F.col("n_predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"))


def rank_auc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve by rank sums with ties shared, and the Brier score."""
    r = ranks(df, keys, [score])
    pos = F.col(truth) == 1
    out = r.groupBy(*keys).agg(F.sum(F.when(pos, F.col(f"{score}_rank"))).alias("_sum"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.avg(F.pow(F.col(truth) - F.col(score), 2)).alias("brier"))
    return out.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"), "brier")


# --- correlation ----------------------------------------------------------

def ranks(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Average ranks within each key, nulls first. Only distinct values are put in order, so of a coarse key with few values no task sorts the rows."""
    for c in columns:
        counts = df.groupBy(*keys, c).agg(F.count("*").alias("_ties"))
        before = F.coalesce(F.sum("_ties").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(c).alias("_value"), (before + (F.col("_ties") + 1) / 2.0).alias(f"{c}_rank"))
        same = F.col(c).eqNullSafe(F.col("_value"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        df = df.join(placed, same).drop("_value", *(f"_k{i}" for i in range(len(keys))))
    return df


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation of complete pairs; null for a constant side or under `least` pairs."""
    r = ranks(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y])
    return r.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(f"{x}_rank", f"{y}_rank").alias("_r")).select(*keys, "n", F.when(F.col("n") >= least, F.col("_r")).alias("spearman"))


def source_agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs, mean and median difference, and Pearson correlation."""
    d = F.col(a) - F.col(b)
    return pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_bias"), F.median(d).alias("median_bias"), safe_corr(a, b).alias("pearson"))


def comparison(df: DataFrame, keys: list[str], local: str, reference: str) -> DataFrame:
    """Correlation, bias, RMSE, quantiles of the difference, and values that only one side has."""
    a, b = F.col(local), F.col(reference)
    d = a - b
    return df.groupBy(*keys).agg(
        F.count(d).alias("n"), safe_corr(local, reference).alias("pearson"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"),
        *(F.percentile(d, q).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)), F.count_if(a.isNotNull() & b.isNull()).alias("only_local"), F.count_if(a.isNull() & b.isNotNull()).alias("only_reference"))


def pooled(df: DataFrame, weight: str, means: list[str], rmse: str) -> DataFrame:
    """Weighted means of per-date statistics, and their RMSE pooled in quadrature."""
    w = F.sum(weight)
    return df.agg(w.alias("n"), *((F.sum(F.col(c) * F.col(weight)) / w).alias(c) for c in means), F.sqrt(F.sum(F.pow(rmse, 2) * F.col(weight)) / w).alias(rmse))


def autocorrelation(df: DataFrame, keys: list[str], value: str, lags: int, month: str = "month") -> DataFrame:
    """Autocorrelation from pairs exactly h months apart, over the whole series' sum of squares."""
    w, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("mi")
    x = df.filter(F.col(value).isNotNull()).select(*keys, month_index(F.col(month)).alias("mi"), (F.col(value) - F.avg(value).over(w)).alias("d"))
    x = x.withColumns({f"_b{h}": F.first("d").over(order.rangeBetween(-h, -h)) for h in range(1, lags + 1)})
    sums = x.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("_ss"), F.count("*").alias("n"), *(a for h in range(1, lags + 1) for a in (F.sum(F.col("d") * F.col(f"_b{h}")).alias(f"_s{h}"), F.count(f"_b{h}").alias(f"_n{h}"))))
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("lag"), F.col(f"_n{h}").alias("n_pairs"), F.col(f"_s{h}").alias("s")) for h in range(1, lags + 1))))
    pairs = sums.select(*keys, "n", "_ss", each.alias("_p")).filter("_p.n_pairs > 0")
    return pairs.select(*keys, "_p.lag", "_p.n_pairs", "n", F.try_divide(F.col("_p.s"), F.nullif("_ss", F.lit(0.0))).alias("acf"))


def ljung_box(acf: DataFrame, keys: list[str]) -> DataFrame:
    """The Ljung-Box statistic over the lags of an autocorrelation table; degrees of freedom: lags with more than two pairs."""
    n = F.col("n").cast("double")
    return acf.filter("acf is not null and n_pairs > 2").groupBy(*keys).agg(F.sum(F.try_divide(n * (n + 2) * F.col("acf") * F.col("acf"), n - F.col("lag"))).alias("q"), F.count("*").alias("df"))


def cross_correlation(df: DataFrame, keys: list[str], driver: str, response: str, lags: int, least: int = 8, month: str = "month") -> DataFrame:
    """Correlation of the response with the driver exactly k months before, k from 0."""
    x = df.select(*keys, month_index(F.col(month)).alias("mi"), driver, response)
    before = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select(*keys, (F.col("mi") + F.col("lag")).alias("mi"), "lag", F.col(driver).alias("_d"))
    pairs = x.select(*keys, "mi", response).join(before, [*keys, "mi"]).filter(F.col("_d").isNotNull() & F.col(response).isNotNull())
    return pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n_pairs"), safe_corr("_d", response).alias("_r")).select(*keys, "lag", "n_pairs", F.when(F.col("n_pairs") >= least, F.col("_r")).alias("ccf"))


# --- skill ----------------------------------------------------------------

def errors(observed: str, predicted: str, weight: str | None = None) -> dict[str, Column]:
    """RMSE, MAE and bias; weights that are not positive count as zero."""
    e = F.col(predicted) - F.col(observed)
    if weight is None:
        return {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "bias": F.avg(e)}
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    w = F.when(e.isNotNull(), w)
    return {n: f(F.try_divide(F.sum(w * v), F.nullif(F.sum(w), F.lit(0.0)))) for n, v, f in (("rmse", e * e, F.sqrt), ("mae", F.abs(e), lambda x: x), ("bias", e, lambda x: x))}


def skill(observed: str, predicted: str, reference: str) -> Column:
    """1 less the ratio of mean squared errors to those of a reference."""
    ok = F.col(predicted).isNotNull() & F.col(reference).isNotNull()
    mse = F.avg(F.when(ok, F.pow(F.col(predicted) - F.col(observed), 2)))
    base = F.avg(F.when(ok, F.pow(F.col(reference) - F.col(observed), 2)))
    return 1 - F.try_divide(mse, F.nullif(base, F.lit(0.0)))


def win_rate(long: DataFrame, block: str, reference: str, model: str = "model", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Share of blocks in which each model's mean squared error is under the reference model's; predictions are held to 0 and 1."""
    mse = long.groupBy(block, model).agg(F.avg(F.pow(clip(F.col(predicted), 0.0, 1.0) - F.col(observed), 2)).alias("mse"))
    ref = mse.filter(F.col(model) == reference).select(block, F.col("mse").alias("_ref"))
    return mse.filter(F.col(model) != reference).join(ref, block).groupBy(model).agg(F.count("*").alias("n_blocks"), F.avg((F.col("mse") < F.col("_ref")).cast("double")).alias("win_rate"))


def monthly_area_error(df: DataFrame, observed: str, predicted: str, area: str, month: str = "month") -> DataFrame:
    """Errors of each month's total area: MAE, RMSE, bias and ratio of totals over months."""
    m = df.groupBy(month).agg(F.sum(clip(F.col(observed), 0.0, 1.0) * F.col(area)).alias("_o"), F.sum(clip(F.col(predicted), 0.0, 1.0) * F.col(area)).alias("_p"))
    e = F.col("_p") - F.col("_o")
    return m.agg(F.count("*").alias("n_months"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), ratio(F.sum("_p"), F.sum("_o")).alias("total_ratio"))


def change_skill(df: DataFrame, observed: str, predicted: str, before: str) -> DataFrame:
    """Skill against persistence, and how often the sign of the change is right."""
    d, p = F.col(observed) - F.col(before), F.col(predicted) - F.col(before)
    return df.agg(F.count(d + p).alias("n"), skill(observed, predicted, before).alias("skill"), F.avg(F.when(d != 0, (F.signum(d) == F.signum(p)).cast("double"))).alias("sign_hits"))


def boyce_windows(df: DataFrame, truth: str, score: str, bins: int = 10, window: float = 0.1) -> DataFrame:
    """Share of presences in every window of scores from 0 to 1 over their share of all rows. Windows are open above, but
    for one that reaches 1; those without a row have no enrichment, and without a presence anywhere it is NaN."""
    step = (1 - window) / (bins - 1)
    plan = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") * step).alias("low"), (F.col("id") * step + window).alias("high"))
    rate = df.agg(F.avg(truth).alias("_rate"))
    s = F.col("_s")
    inside = (s >= F.col("low")) & ((s < F.col("high")) | ((F.col("high") >= 1 - 1e-12) & (s <= F.col("high") + 1e-12)))
    got = df.select(F.col(truth).alias("_t"), F.col(score).alias("_s")).join(F.broadcast(plan), inside).groupBy("bin").agg(F.avg("_t").alias("_share"), F.count("_t").alias("n"))
    out = plan.join(got, "bin", "left").join(F.broadcast(rate))
    return out.select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("_rate") > 0, F.col("_share") / F.col("_rate")).when(F.col("_share").isNotNull(), float("nan")).alias("enrichment"))


def boyce(df: DataFrame, truth: str, score: str, bins: int = 10, window: float = 0.1) -> DataFrame:
    """The Boyce index: rank correlation of window midpoints with enrichment, and n, the windows with rows. Always one row; null under three windows, or where all rows or none are presences."""
    w = boyce_windows(df, truth, score, bins, window).withColumn("middle", (F.col("low") + F.col("high")) / 2).withColumn("_all", F.lit(1))
    return spearman(w, ["_all"], "middle", "enrichment").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("spearman").alias("boyce"))


def residual_correlation(df: DataFrame, cell: str, observed: str, predicted: str, baseline: str, least_months: int = 4, least_distinct: int = 3, month: str = "month") -> DataFrame:
    """Mean over cells of the rank correlation of departures from a baseline; cells without one are counted by reason."""
    d = df.select(cell, month, (F.col(observed) - F.col(baseline)).alias("_o"), (F.col(predicted) - F.col(baseline)).alias("_p")).dropna(subset=["_o", "_p"])
    size = d.groupBy(cell).agg(F.countDistinct(month).alias("_m"), F.countDistinct(F.round("_o", 12)).alias("_d"))
    per = spearman(d, [cell], "_o", "_p").join(size, cell)
    short, flat = F.col("_m") < least_months, F.col("_d") < least_distinct
    r = F.when(~short & ~flat, F.col("spearman"))
    return per.agg(F.avg(r).alias("mean_spearman"), F.count(r).alias("n_scored"), F.count("*").alias("n_cells"), F.count_if(short).alias("n_short"), F.count_if(~short & flat).alias("n_constant"), F.count_if(~short & ~flat & F.col("spearman").isNull()).alias("n_undefined"))


def variance_parts(df: DataFrame, value: str, region: str, month: str = "month") -> DataFrame:
    """Sums of squares between months, between regions, of their interaction, and in total."""
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.col(region).alias("r"), F.col(month).alias("m"))
    by = lambda k, out: x.groupBy(k).agg(F.avg("x").alias(out))
    x = x.join(by("m", "xm"), "m").join(by("r", "xr"), "r").join(F.broadcast(x.agg(F.avg("x").alias("g"))))
    sq = lambda e: F.sum(F.pow(e, 2))
    return x.agg(F.count("*").alias("n"), sq(F.col("x") - F.col("g")).alias("ss_total"), sq(F.col("xm") - F.col("g")).alias("ss_month"), sq(F.col("xr") - F.col("g")).alias("ss_region"), sq(F.col("x") - F.col("xm")).alias("ss_within_month"), sq(F.col("x") - F.col("xm") - F.col("xr") + F.col("g")).alias("ss_interaction"))


# --- tables ---------------------------------------------------------------

def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and column with margins; 'All' names a margin."""
    out = df.groupBy(F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column)).count()
    out = out.cube(row, column).agg(F.sum("count").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    return out.select(F.when(F.col("_r") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("_c") == 1, "All").otherwise(F.col(column)).alias(column), "n")


def row_shares(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).count().withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(row)))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.percentile(value, 0.25).alias("q25"), F.median(value).alias("median"), F.percentile(value, 0.75).alias("q75"), F.max(value).alias("max"))


def presence_table(df: DataFrame, cover: str, whole: str, thresholds: list[float]) -> DataFrame:
    """For each cover threshold: cell-months that reach it, their share, and their share of the covered area."""
    part = F.col(cover) * F.col(whole)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col(cover) >= t, F.lit(False))
        aggs += [F.count_if(hit).alias(f"_n{i}"), F.sum(F.when(hit, part)).alias(f"_a{i}")]
    row = df.agg(F.count("*").alias("n_rows"), F.sum(part).alias("_all"), *aggs)
    out = row.select("n_rows", "_all", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_n{i}").alias("n_present"), F.col(f"_a{i}").alias("_a")) for i, t in enumerate(thresholds)))).alias("_s"))
    return out.select("_s.threshold", "_s.n_present", ratio(F.col("_s.n_present"), F.col("n_rows")).alias("prevalence"), F.coalesce(ratio(F.col("_s._a"), F.col("_all")), F.lit(0.0)).alias("area_share"))


def quantile_groups(df: DataFrame, value: str, groups: int = 3, out: str = "tertile") -> DataFrame:
    """Which of the quantile groups (1 to groups) a value falls in; cut points belong to the lower group."""
    cuts = df.agg(F.percentile(value, F.array(*(F.lit(i / groups) for i in range(1, groups)))).alias("_cuts"))
    rank = F.size(F.filter("_cuts", lambda c: c < F.col(value))) + 1
    return df.join(F.broadcast(cuts)).withColumn(out, F.when(F.col(value).isNotNull(), rank)).drop("_cuts")


def wide_to_schemes(df: DataFrame, keys: list[str], scheme: str, schemes: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows and schemes as columns."""
    long = df.unpivot([*keys, scheme], metrics, "metric", "value")
    return long.groupBy(*keys, "metric").pivot(scheme, schemes).agg(F.first("value"))


def chi2_tail(q: float, df: int) -> float:
    """P(X > q) for a chi-squared variable, by the incomplete gamma function."""
    a, x = df / 2, q / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h
