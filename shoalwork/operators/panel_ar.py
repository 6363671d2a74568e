"""Regression with autoregressive errors on a region-by-month panel, its residuals and one-month forecasts, from sums of products.

The model: an intercept for each region, the season's harmonics, a trend and drivers, with errors that follow an autoregression over
calendar months within a region, fitted by Cochrane and Orcutt's rounds: coefficients on rows less the errors' carry-over
from earlier months, then the autoregression of what they leave.

No round reads rows again. A row's vector w holds 1, the trend and season of its month, and y and drivers of it and of the months
before; what any autoregression takes off is a linear map of w (trend and season of earlier months are such maps already), so products of w
settle every round. The regions' intercepts are taken out by the regions' mean vectors, whose products are sums over regions. So a fit
reads a few matrices of the size of w: products within regions by month (which also give errors clustered by month), and products of
rows whose earlier residuals are there. Leaving a region out subtracts its own products; a fit at each origin adds months up.
Regions and rows may be of any number. Months are bounded by the calendar; one row of moments holds a small matrix for each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import month_index, month_of_index
from .stats import aicc, complete, gaussian_llf

COEFFICIENTS = "term string, kind string, estimate double, std_error double, t double, p double, n long, n_clusters long, aicc double"
FITTED = "order int, usable boolean, n long, rho array<double>, beta array<double>, level array<double>, criterion double"
EPOCH = 24000  # the trend is in years from this month


@dataclass(frozen=True)
class Form:
    """What a model's vectors hold. centre: means that are taken off y, the drivers and the month beforehand."""

    drivers: tuple[str, ...]
    lags: int
    harmonics: int
    trend: bool
    centre: tuple[float, ...]  # y, drivers, month

    @property
    def fixed(self) -> int:
        return 1 + self.trend + 2 * self.harmonics

    @property
    def size(self) -> int:
        return self.fixed + (1 + len(self.drivers)) * (self.lags + 1)

    @property
    def terms(self) -> list[tuple[str, str]]:
        season = [(f"{f}{k}", "season") for k in range(1, self.harmonics + 1) for f in ("sin", "cos")]
        return ([("trend", "trend")] if self.trend else []) + season + [(d, "driver") for d in self.drivers]

    @property
    def offsets(self) -> np.ndarray:
        """By how much each term's column was shifted by centring."""
        return np.array(([(self.centre[-1] - EPOCH) / 12] if self.trend else []) + [0.0] * (2 * self.harmonics) + list(self.centre[1:-1]))

    def back(self, h: int) -> np.ndarray:
        """The map from w to y and the terms h months earlier."""
        out = np.zeros((1 + len(self.terms), self.size))
        own = self.fixed + h * (1 + len(self.drivers))
        out[0, own] = 1
        if self.trend:
            out[1, 0], out[1, 1] = -h / 12, 1
        for k in range(1, self.harmonics + 1):
            i, turn = self.trend + 2 * k - 1, 2 * math.pi * k * h / 12
            out[i : i + 2, i : i + 2] = [[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]]
        for j in range(len(self.drivers)):
            out[self.fixed + j, own + 1 + j] = 1
        return out

    def month_terms(self, mi: Column) -> list[Column]:
        turn = 2 * math.pi / 12 * (mi % 12 + 1)
        return ([(mi - self.centre[-1]) / 12.0] if self.trend else []) + [f(k * turn) for k in range(1, self.harmonics + 1) for f in (F.sin, F.cos)]

    def without_drivers(self) -> tuple[Form, list[int]]:
        """The form without drivers, and the places of its vectors in this one's."""
        own = [self.fixed + h * (1 + len(self.drivers)) for h in range(self.lags + 1)]
        return Form((), self.lags, self.harmonics, self.trend, (self.centre[0], self.centre[-1])), [*range(self.fixed), *own]


@dataclass
class Moments:
    """Of the rows whose lags are all there: n, products within regions, their sum over regions of mean times sum (between). Of those whose earlier residuals
    are there too (deep): n, products, sums over regions of mean times their sum, and of their number times the mean's products. regions: how many the panel has."""

    n: float
    within: np.ndarray
    deep_n: float
    deep: np.ndarray
    cross: np.ndarray
    level: np.ndarray
    regions: int


@dataclass
class Fit:
    """beta: of the terms; rho: of the errors; level: times a region's mean vector its intercept, all in centred units."""

    form: Form
    order: int
    n: int
    usable: bool
    beta: np.ndarray
    rho: np.ndarray
    level: np.ndarray
    apart: np.ndarray  # the map from w to y and terms less their carry-over
    bread: np.ndarray
    rank: int
    criterion: float

    @property
    def c(self) -> np.ndarray:
        return np.concatenate(([1.0], -self.beta))

    def spread(self, scores: np.ndarray) -> float:
        """What cluster sums of squares are multiplied by: the usual correction for few clusters."""
        g = len(scores)
        return g / max(1, g - 1) * (self.n - 1) / max(1, self.n - self.rank)


def scaled_solve(g: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(g), 0))
    d = np.where(d > 0, d, 1)
    return np.linalg.lstsq(g / np.outer(d, d), rhs / d, rcond=None)[0] / d


def fit_moments(m: Moments, form: Form, order: int, rounds: int = 50) -> Fit:
    back = [form.back(h) for h in range(order + 1)]
    k, n = m.regions + len(form.terms), int(m.n)
    rho, beta = np.zeros(order), np.zeros(len(form.terms))
    apart = back[0]
    if n <= k + order:
        return Fit(form, order, n, False, beta, rho, np.zeros(form.size), apart, np.zeros((len(beta), len(beta))), k, math.nan)

    def solved() -> np.ndarray:
        g = apart @ m.within @ apart.T
        return scaled_solve(g[1:, 1:], g[1:, 0]) if len(beta) else beta

    def level() -> np.ndarray:
        left = 1 - rho.sum()
        return (np.concatenate(([1.0], -beta)) @ apart) / left if abs(left) > 1e-12 else np.zeros(form.size)

    for _ in range(max(1, rounds)):
        beta = solved()
        if not order:
            break
        v, g = np.array([np.concatenate(([1.0], -beta)) @ b for b in back]), level()
        aside = v @ (m.cross.T @ g)  # each lag's residual without intercept, times the intercepts
        a = v @ m.deep @ v.T - aside[:, None] - aside[None, :] + g @ m.level @ g
        new = scaled_solve(a[1:, 1:], a[1:, 0]) if m.deep_n > order + 1 else np.zeros(order)
        moved, rho = np.abs(new - rho).max(), new
        apart = back[0] - sum(r * b for r, b in zip(rho, back[1:]))
        if moved < 1e-7:
            break
    beta = solved()
    g = apart @ m.within @ apart.T
    c = np.concatenate(([1.0], -beta))
    rss = max(float(c @ g @ c), 1e-300)
    bread = np.linalg.pinv(g[1:, 1:], hermitian=True) if len(beta) else np.zeros((0, 0))
    return Fit(form, order, n, True, beta, rho, level(), apart, bread, k, aicc(gaussian_llf(rss, n), k + order + 1, n))


def month_scores(fit: Fit, by_month: np.ndarray) -> np.ndarray:
    """Each month's sum of terms times residuals, from its products within regions."""
    return np.einsum("ij,gjk,k->gi", fit.apart[1:], by_month, fit.c @ fit.apart)


def two_sided(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def _row(term: str, kind: str, estimate: float, variance: float | None, fit: Fit, clusters: int) -> tuple:
    se = None if variance is None else math.sqrt(max(variance, 0.0))
    return (term, kind, float(estimate), se, float(estimate / se) if se else None, two_sided(estimate / se) if se else None, fit.n, clusters, float(fit.criterion))


def term_rows(fit: Fit, by_month: np.ndarray) -> list[tuple]:
    """Rows of all terms but the regions, with errors clustered by month."""
    scores = month_scores(fit, by_month)
    cov = fit.bread @ (scores.T @ scores) @ fit.bread * fit.spread(scores)
    out = [_row(term, kind, b, v, fit, len(scores)) for (term, kind), b, v in zip(fit.form.terms, fit.beta, np.diag(cov))]
    return out + [_row(f"rho{h}", "errors", r, None, fit, len(scores)) for h, r in enumerate(fit.rho, 1)]


def region_row(region: str, fit: Fit, scores: np.ndarray, mean: np.ndarray, own: np.ndarray, months: np.ndarray, n: int) -> tuple:
    """A region's intercept. own: its rows' vectors less their mean, months: the places of theirs among the scores."""
    left, x = 1 - fit.rho.sum(), fit.apart[1:] @ mean
    shift = fit.form.offsets
    x = x + left * shift  # means of the terms as they were before centring
    estimate = fit.level @ mean + fit.form.centre[0] - shift @ fit.beta
    each = -(scores @ fit.bread @ x)
    np.add.at(each, months, own @ (fit.c @ fit.apart) / n)
    return _row(f"region {region}", "region", estimate, (each @ each) / left**2 * fit.spread(scores) if abs(left) > 1e-12 else None, fit, len(scores))


# --- rows -----------------------------------------------------------------------------------------------------------------


def prepared(df: DataFrame, region: str, y: str, drivers: list[str], month: str, *more: str) -> DataFrame:
    """more, region, mi, y and drivers (d0, d1 ...) of complete rows, one for each region and month (that of least y where several are)."""
    rows = complete(df, [y, *drivers])
    names = ["y", *(f"d{j}" for j in range(len(drivers)))]
    rows = rows.select(*more, F.col(region).cast("string").alias("region"), month_index(F.col(month)).alias("mi"), *(F.col(c).cast("double").alias(n) for c, n in zip([y, *drivers], names)))
    return rows.filter("mi is not null").groupBy(*more, "region", "mi").agg(F.min(F.struct(*names)).alias("_v")).select(*more, "region", "mi", "_v.*")


def form_of(rows: DataFrame, drivers: list[str], lags: int, harmonics: int, trend: bool) -> Form:
    names = ["y", *(f"d{j}" for j in range(len(drivers))), "mi"]
    means = rows.agg(*(F.avg(c).alias(c) for c in names)).first()
    return Form(tuple(drivers), lags, harmonics, trend, tuple(float(means[c] or 0.0) for c in names))


def lagged(rows: DataFrame, form: Form, order: int, keys: list[str]) -> DataFrame:
    """rows with w (null where a lag is not there) and deep (the residuals of the last `order` months are there too)."""
    names = ["y", *(f"d{j}" for j in range(len(form.drivers)))]
    own = F.struct(*((F.col(c) - m).alias(c) for c, m in zip(names, form.centre)))
    by = Window.partitionBy(*keys, "region").orderBy("mi")
    rows = rows.withColumn("_v0", own)
    rows = rows.withColumns({f"_v{h}": F.first("_v0").over(by.rangeBetween(-h, -h)) for h in range(1, form.lags + order + 1)})
    held = [f"_v{h}" for h in range(form.lags + 1)]
    w = F.array(F.lit(1.0), *(t.cast("double") for t in form.month_terms(F.col("mi"))), *(F.col(f"{v}.{c}") for v in held for c in names))
    there = lambda v: F.col(v).isNotNull()
    sample, deep = F.lit(True), F.lit(True)
    for v in held:
        sample = sample & there(v)
    for h in range(1, form.lags + order + 1):
        deep = deep & there(f"_v{h}")
    return rows.withColumns({"w": F.when(sample, w), "deep": sample & deep})


def pairs(q: int) -> list[tuple[int, int]]:
    return list(itertools.combinations_with_replacement(range(q), 2))


def products(a: str, q: int, weight: Column | None = None) -> Column:
    """Sums of products of the entries of an array with one another, in the order of pairs."""
    get = lambda i: F.get(a, F.lit(i))
    return F.array(*(F.sum(get(i) * get(j) if weight is None else weight * get(i) * get(j)) for i, j in pairs(q)))


def square(values, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    if values is not None:
        for (i, j), v in zip(pairs(q), values):
            out[i, j] = out[j, i] = v or 0.0
    return out


def region_vectors(sample: DataFrame, q: int, keys: list[str]) -> DataFrame:
    """Of each region: n, mean (of w), deep_n and deep_sum."""
    deep = F.when(F.col("deep"), F.col("w"))
    return sample.withColumn("_d", deep).groupBy(*keys, "region").agg(
        F.count("*").alias("n"), F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(q))).alias("mean"), F.count("_d").alias("deep_n"),
        F.array(*(F.coalesce(F.sum(F.get("_d", F.lit(i))), F.lit(0.0)) for i in range(q))).alias("deep_sum"))


def between(regions: DataFrame, q: int, keys: list[str]) -> DataFrame:
    """Sums over regions: cross (mean times deep_sum, by rows) and level (deep_n times the mean's products)."""
    cross = F.array(*(F.sum(F.get("mean", F.lit(i)) * F.get("deep_sum", F.lit(j))) for i in range(q) for j in range(q)))
    return regions.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("deep_n").alias("deep_n"), cross.alias("cross"), products("mean", q, F.col("deep_n")).alias("level"))


def centred(sample: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """The sample with v, its vectors less their region's mean."""
    own = regions.select(*keys, F.col("region").alias("_region"), "mean", F.col("n").alias("_n"))
    on = [F.col("region").eqNullSafe(F.col("_region"))]
    x, y = sample.alias("x"), own.alias("y")
    on += [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    v = F.zip_with("w", "mean", lambda a, b: a - b)
    return x.join(y, on).select("x.*", "mean", "_n", v.alias("v"))


def moments(rows: DataFrame, sample: DataFrame, regions: DataFrame, form: Form, keys: list[str]) -> DataFrame:
    """One row for each panel (keys, which must be given): see Moments; months: structs of mi, n and h, the month's products within regions."""
    q = form.size
    by_month = centred(sample, regions, keys).groupBy(*keys, "mi").agg(F.count("*").alias("_c"), products("v", q).alias("h")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("mi", F.col("_c").alias("n"), "h"))).alias("months"))
    deep = sample.withColumn("_w", F.when(F.col("deep"), F.col("w"))).groupBy(*keys).agg(products("_w", q).alias("deep"))
    many = rows.groupBy(*keys).agg(F.count_distinct(F.struct("region")).alias("regions"))
    parts = between(regions, q, keys)
    for t in (by_month, deep, many):
        parts = parts.unionByName(t, allowMissingColumns=True)
    out = parts.groupBy(*keys).agg(*(F.first(c, True).alias(c) for c in parts.columns if c not in keys))  # each comes from one part
    return out.filter("n is not null")


def moments_of(row, form: Form) -> tuple[Moments, np.ndarray, list[int]]:
    q = form.size
    by_month = np.array([square(m["h"], q) for m in row["months"]]).reshape(-1, q, q)
    m = Moments(row["n"], by_month.sum(0), row["deep_n"], square(row["deep"], q), np.array([v or 0.0 for v in row["cross"]]).reshape(q, q), square(row["level"], q), row["regions"])
    return m, by_month, [m["mi"] for m in row["months"]]


def _one(df: DataFrame) -> DataFrame:
    """df as one panel: its key is a column of zeros that the optimizer takes for any other, so joins by it stay equi-joins."""
    return df.withColumn("_one", F.pmod(F.xxhash64("region"), F.lit(1)))


def _fields(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(more).fields])


def panel_ar(df: DataFrame, region: str, y: str, drivers: list[str], order: int = 1, keys: list[str] = (), most_lags: int | None = None, harmonics: int = 2, trend: bool = True, month: str = "month") -> DataFrame:
    """Coefficients of each panel (keys) with errors clustered by month, the errors' lags, and the criterion.

    A panel with too few rows whose lags are all observed gives no rows, and a region without such a row has none.
    """
    keys = list(keys)
    rows = _one(prepared(df, region, y, drivers, month, *keys))
    keys_in = keys or ["_one"]
    form = form_of(rows, drivers, max(order, most_lags or 0), harmonics, trend)
    sample = lagged(rows, form, order, keys_in).filter("w is not null").select(*keys_in, "region", "mi", "w", "deep")
    regions = region_vectors(sample, form.size, keys_in)
    every = moments(rows, sample, regions, form, keys_in)

    def terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                m, by_month, _ = moments_of(row, form)
                fit = fit_moments(m, form, order)
                if fit.usable:
                    out += [(*(row[k] for k in keys), *r) for r in term_rows(fit, by_month)]
            yield pd.DataFrame(out, columns=names)

    def intercepts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                m, by_month, calendar = moments_of(row, form)
                fit = fit_moments(m, form, order)
                if fit.usable:
                    place = {mi: i for i, mi in enumerate(calendar)}
                    own = np.array([list(v["v"]) for v in row["own"]])
                    out.append((*(row[k] for k in keys), *region_row(row["region"], fit, month_scores(fit, by_month), np.array(row["mean"]), own, np.array([place[v["mi"]] for v in row["own"]]), row["_n"])))
            yield pd.DataFrame(out, columns=names)

    schema = _fields(rows, keys, COEFFICIENTS)
    names = [f.name for f in schema.fields]
    own = centred(sample, regions, keys_in).groupBy(*keys_in, "region").agg(F.first("mean").alias("mean"), F.first("_n").alias("_n"), F.collect_list(F.struct("mi", "v")).alias("own"))
    return every.mapInPandas(terms, schema).unionByName(own.join(every, keys_in).mapInPandas(intercepts, schema))


def order_table(df: DataFrame, region: str, y: str, drivers: list[str], most_lags: int = 3, month: str = "month", harmonics: int = 2, trend: bool = True) -> DataFrame:
    """The criterion of every order up to most_lags on one and the same sample: order, n, aicc and chosen.

    An order for whose coefficients the sample has too few rows has a null aicc and is not chosen. An empty panel gives no rows.
    """
    rows = prepared(df, region, y, drivers, month)
    form = form_of(rows, drivers, most_lags, harmonics, trend)
    deeper = F.lit(0)
    found = lagged(rows, form, most_lags, [])
    for o in range(1, most_lags + 1):  # how many earlier residuals are there, without a gap
        deeper = F.when(F.coalesce(*(F.when(F.col(f"_v{h}").isNull(), True) for h in range(1, form.lags + o + 1)), F.lit(False)), deeper).otherwise(F.lit(o))
    sample = found.withColumn("_most", deeper).filter("w is not null").withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(most_lags)))).withColumn("deep", F.col("_most") >= F.col("order"))
    every = moments(rows.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(most_lags)))), sample, region_vectors(sample, form.size, ["order"]), form, ["order"])

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [fit_moments(moments_of(row, form)[0], form, row["order"]) for row in pdf.to_dict("records")]
            yield pd.DataFrame({"order": pdf["order"], "n": [f.n for f in got], "aicc": pd.Series([f.criterion if f.usable else None for f in got], dtype=object)})

    table = every.mapInPandas(fit, "order int, n long, aicc double")
    orders = rows.agg(F.count("*").alias("_c")).filter("_c > 0").select(F.explode(F.sequence(F.lit(0), F.lit(most_lags))).alias("order"))
    table = orders.join(table, "order", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("aicc", F.when(~F.isnan("aicc"), F.col("aicc")))
    best = F.min(F.when(F.col("aicc").isNotNull(), F.struct("aicc", "order"))).over(Window.partitionBy(F.lit(0)))["order"]  # a row for each order
    return table.withColumn("chosen", F.coalesce(F.col("order") == best, F.lit(False)))


def _fit_rows(every: DataFrame, form: Form, order: int, keys: list[str]) -> DataFrame:
    """keys and FITTED of rows of moments."""

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [fit_moments(moments_of(row, form)[0], form, order) for row in pdf.to_dict("records")]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "order": order, "usable": [f.usable for f in got], "n": [f.n for f in got], "rho": [f.rho.tolist() for f in got], "beta": [f.beta.tolist() for f in got],
                                "level": [f.level.tolist() for f in got], "criterion": [f.criterion for f in got]})

    return every.mapInPandas(fit, _fields(every, keys, FITTED))


def dot(array: str, columns: list[Column]) -> Column:
    """An array times as many columns."""
    return sum((F.get(array, F.lit(i)) * c for i, c in enumerate(columns)), F.lit(0.0))


def panel_residuals(df: DataFrame, region: str, y: str, drivers: list[str], order: int = 1, month: str = "month", harmonics: int = 2, trend: bool = True) -> DataFrame:
    """region, month, y, fitted and residual (in the units of y) of the rows that the fit could use."""
    rows = _one(prepared(df, region, y, drivers, month))
    form = form_of(rows, drivers, order, harmonics, trend)
    sample = lagged(rows, form, order, ["_one"]).filter("w is not null").select("_one", "region", "mi", "y", "w", "deep")
    regions = region_vectors(sample, form.size, ["_one"])
    fits = _fit_rows(moments(rows, sample, regions, form, ["_one"]), form, order, ["_one"]).filter("usable")
    own = F.get("w", F.lit(form.fixed))  # y, centred
    terms = [F.get("w", F.lit(i)) for i in range(1, form.fixed)] + [F.get("w", F.lit(form.fixed + 1 + j)) for j in range(len(drivers))]
    level = F.aggregate(F.zip_with("level", "mean", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    e = own - dot("beta", terms) - level
    got = centred(sample, regions, ["_one"]).join(F.broadcast(fits), "_one").withColumn("residual", e)  # one fit
    return got.select("region", month_of_index(F.col("mi")).alias("month"), "y", (F.col("y") - F.col("residual")).alias("fitted"), "residual")


def feasible_origins(df: DataFrame, least_months: int = 24, month: str = "month") -> DataFrame:
    """Every month with least_months observed months up to it and an observation the month after: origin (its number), n_months. One row for each month of the calendar."""
    months = df.select(month_index(F.col(month)).alias("mi")).filter("mi is not null").distinct()
    by = Window.partitionBy(F.lit(0)).orderBy("mi")  # months of the calendar, so few
    counted = months.select(F.col("mi").alias("origin"), F.count("*").over(by).alias("n_months"), F.lead("mi").over(by).alias("_next"))
    return counted.filter((F.col("_next") == F.col("origin") + 1) & (F.col("n_months") >= least_months)).drop("_next")


def origin_moments(rows: DataFrame, found: DataFrame, form: Form, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments of the months up to each origin, by running sums over months, and each region's n, mean and row count up to it."""
    q = form.size
    first, last = rows.agg(F.min("mi"), F.max("mi")).first()
    deep, taken = F.when(F.col("deep"), F.col("w")), F.col("w").isNotNull()
    # a row for each region and month of the calendar
    grid = rows.groupBy("region").agg(F.min("mi").alias("_from")).withColumn("mi", F.explode(F.sequence("_from", F.lit(last)))) if first is not None else rows.select("region", F.col("mi").alias("_from"), "mi")
    own = found.select(F.col("region").alias("_r"), F.col("mi").alias("_m"), "w", deep.alias("_d"))
    full = grid.join(own, F.col("region").eqNullSafe(F.col("_r")) & (F.col("mi") == F.col("_m")), "left")
    run = Window.partitionBy("region").orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)
    added = lambda a: F.array(*(F.coalesce(F.sum(F.get(a, F.lit(i))).over(run), F.lit(0.0)) for i in range(q)))
    upto = full.select("region", F.col("mi").alias("origin"), F.count("_m").over(run).alias("n_rows"), F.count(F.when(taken, 1)).over(run).alias("n"), added("w").alias("_sum"), F.count("_d").over(run).alias("deep_n"), added("_d").alias("deep_sum"))
    upto = upto.join(origins, "origin", "left_semi").withColumn("mean", F.transform("_sum", lambda v: F.when(F.col("n") > 0, v / F.col("n")).otherwise(F.lit(0.0))))
    apart = upto.groupBy("origin").agg(
        F.sum("n_rows").alias("n_rows"), F.count("*").alias("regions"), F.sum("n").alias("n"), F.sum("deep_n").alias("deep_n"), products("mean", q, F.col("n")).alias("_between"),
        F.array(*(F.sum(F.get("mean", F.lit(i)) * F.get("deep_sum", F.lit(j))) for i in range(q) for j in range(q))).alias("cross"), products("mean", q, F.col("deep_n")).alias("level"))
    by_month = found.withColumn("_d", deep).groupBy("mi").agg(products("w", q).alias("_w"), products("_d", q).alias("_deep"))
    months = Window.partitionBy(F.lit(0)).orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)  # months of the calendar, so few
    m = len(pairs(q))
    total = lambda a: F.array(*(F.coalesce(F.sum(F.get(a, F.lit(i))).over(months), F.lit(0.0)) for i in range(m)))
    summed = by_month.select(F.col("mi").alias("origin"), total("_w").alias("_total"), total("_deep").alias("deep"))
    both = apart.join(summed, "origin")
    within = F.zip_with("_total", "_between", lambda a, b: a - b)
    every = both.select("origin", "n_rows", "n", "deep_n", "regions", "cross", "level", "deep", F.array(F.struct(F.col("origin").alias("mi"), within.alias("h"))).alias("months"))
    return every, upto.select("region", "origin", "mean", F.col("n").alias("_n"))


def one_month_forecasts(df: DataFrame, region: str, y: str, drivers: list[str], order: int = 1, least_months: int = 24, least_rows: int = 30, month: str = "month", harmonics: int = 2, trend: bool = True) -> DataFrame:
    """Forecasts of every region one month after every feasible origin, fitted on the months up to the origin alone.

    Returns origin and target (months), region, observed, plain (without drivers), full, persistence and seasonal (y one and
    twelve months before; null if not observed) and n_errors (earlier errors used). Forecasts of a region without a usable row up to the origin are null.
    Origins with fewer than least_rows rows, or too few with their lags, are left out.
    """
    rows = prepared(df, region, y, drivers, month)
    form = form_of(rows, drivers, order, harmonics, trend)
    bare, places = form.without_drivers()
    found = lagged(rows, form, order, [])
    origins = feasible_origins(complete(df, [y, *drivers]), least_months, month).select("origin")
    every, means = origin_moments(rows, found, form, origins)

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                m, _, _ = moments_of(row, form)
                some = np.ix_(places, places)
                plain = fit_moments(Moments(m.n, m.within[some], m.deep_n, m.deep[some], m.cross[some], m.level[some], m.regions), bare, order)
                full = fit_moments(m, form, order)
                if plain.usable and full.usable:
                    spread = np.zeros(form.size)
                    spread[places] = plain.level
                    out.append((row["origin"], plain.beta.tolist(), plain.rho.tolist(), spread.tolist(), full.beta.tolist(), full.rho.tolist(), full.level.tolist()))
            yield pd.DataFrame(out, columns=["origin", "beta0", "rho0", "level0", "beta1", "rho1", "level1"])

    fits = every.filter(F.col("n_rows") >= least_rows).mapInPandas(fit, "origin int, " + ", ".join(f"{c}{i} array<double>" for i in (0, 1) for c in ("beta", "rho", "level")))
    by = Window.partitionBy("region").orderBy("mi")
    names = ["y", *(f"d{j}" for j in range(len(drivers)))]
    ahead = found.withColumns({"persistence": F.first("y").over(by.rangeBetween(-1, -1)), "seasonal": F.first("y").over(by.rangeBetween(-12, -12))}).withColumn("origin", F.col("mi") - 1)
    x, m = ahead.alias("x"), means.withColumnRenamed("region", "_r").alias("m")
    both = x.join(F.broadcast(fits), "origin")  # one row for each month of the calendar
    both = both.join(m, (F.col("x.region").eqNullSafe(F.col("_r"))) & (F.col("x.origin") == F.col("m.origin")), "left")

    def values(h: int, with_drivers: bool) -> list[Column]:
        return [t.cast("double") for t in form.month_terms(F.col("x.mi") - h)] + ([F.col(f"_v{h}.{c}") for c in names[1:]] if with_drivers else [])

    def there(h: int) -> Column:
        """Whether the residual h months before the target is known."""
        ok = F.lit(True)
        for k in range(h, h + form.lags + 1):
            ok = ok & F.col(f"_v{k}").isNotNull()
        return ok

    def expected(i: int) -> Column:
        level = F.aggregate(F.zip_with(f"level{i}", "mean", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        out = F.lit(form.centre[0]) + level + dot(f"beta{i}", values(0, bool(i)))
        for h in range(1, order + 1):
            e = F.col(f"_v{h}.y") - dot(f"beta{i}", values(h, bool(i))) - level
            out = out + F.get(f"rho{i}", F.lit(h - 1)) * F.when(there(h), e).otherwise(F.lit(0.0))
        return F.when(F.col("_n") > 0, out)

    used = sum((there(h).cast("int") for h in range(1, order + 1)), F.lit(0))
    return both.select(month_of_index(F.col("x.origin")).alias("origin"), month_of_index(F.col("x.mi")).alias("target"), "x.region", F.col("x.y").alias("observed"), expected(0).alias("plain"), expected(1).alias("full"), "persistence", "seasonal", used.cast("int").alias("n_errors"))


def without_each_region(df: DataFrame, region: str, y: str, drivers: list[str], order: int = 1, month: str = "month", harmonics: int = 2, trend: bool = True) -> DataFrame:
    """The drivers' coefficients with each region left out in turn: left_out and the columns of panel_ar.

    Each fit subtracts the region's own products from the panel's, which are a few matrices; regions may be many.
    """
    rows = _one(prepared(df, region, y, drivers, month))
    form = form_of(rows, drivers, order, harmonics, trend)
    q = form.size
    sample = lagged(rows, form, order, ["_one"]).filter("w is not null").select("_one", "region", "mi", "w", "deep")
    regions = region_vectors(sample, q, ["_one"])
    total = moments(rows, sample, regions, form, ["_one"]).first()  # one row of small matrices
    names = ["left_out", *(f.name for f in T._parse_datatype_string(COEFFICIENTS).fields)]
    schema = f"left_out string, {COEFFICIENTS}"
    if total is None:
        return df.sparkSession.createDataFrame([], schema)
    total = total.asDict(recursive=True)
    own = centred(sample.withColumn("_d", F.when(F.col("deep"), F.col("w"))), regions, ["_one"]).groupBy("region").agg(
        F.first("mean").alias("mean"), F.first("_n").alias("n"), F.count("_d").alias("deep_n"), products("_d", q).alias("deep"), F.array(*(F.coalesce(F.sum(F.get("_d", F.lit(i))), F.lit(0.0)) for i in range(q))).alias("deep_sum"),
        F.collect_list(F.struct("mi", "v")).alias("own"))
    every = rows.select("region").distinct().withColumnRenamed("region", "left_out")
    each = every.join(own, F.col("left_out").eqNullSafe(F.col("region")), "left")

    def fit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, by_month, calendar = moments_of(total, form)
        place = {mi: i for i, mi in enumerate(calendar)}
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                left, rest = Moments(m.n, m.within, m.deep_n, m.deep, m.cross, m.level, m.regions - 1), by_month
                if row["own"] is not None:  # else it has no row in the sample
                    rest, mean = by_month.copy(), np.array(row["mean"])
                    met = np.array([h["n"] for h in total["months"]])
                    for v in row["own"]:
                        rest[place[v["mi"]]] -= np.outer(v["v"], v["v"])
                        met[place[v["mi"]]] -= 1
                    n, deep_n = int(row["n"]), int(row["deep_n"])
                    left = Moments(m.n - n, rest.sum(0), m.deep_n - deep_n, m.deep - square(row["deep"], q), m.cross - np.outer(mean, row["deep_sum"]), m.level - deep_n * np.outer(mean, mean), m.regions - 1)
                    rest = rest[met > 0]
                got = fit_moments(left, form, order)
                if got.usable:
                    out += [(row["left_out"], *r) for r in term_rows(got, rest) if r[1] == "driver"]
            yield pd.DataFrame(out, columns=names)

    return each.mapInPandas(fit, schema)
