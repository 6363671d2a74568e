"""State-space regressions of monthly series: a wandering level or autoregressive errors, with gaps, one task for each series.

A Kalman filter runs over the response and all regressors at once, as its gains depend on none of them; the standardized
innovations are then a plain least-squares problem, so only the structure's own parameters are searched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import month_index, month_of_index
from .metrics import chi2_tail
from .stats import aicc, ar_roots

STRUCTURES = {"level": 1, "ar1": 1, "ar2": 2}  # parameters of each
DIFFUSE = 1e7


def _system(structure: str, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Transition, state noise, observation noise and the state's first covariance, in units of the innovation variance."""
    if structure == "level":
        return np.eye(1), np.array([[math.exp(parameters[0])]]), 1.0, np.array([[DIFFUSE]])
    if structure == "ar1":
        r = math.tanh(parameters[0])
        return np.array([[r]]), np.eye(1), 0.0, np.array([[1 / max(1e-9, 1 - r * r)]])
    a, b = np.tanh(parameters)  # partial autocorrelations, so every pair is stable
    t = np.array([[a * (1 - b), b], [1.0, 0.0]])
    q = np.diag([1.0, 0.0])
    p = np.linalg.solve(np.eye(4) - np.kron(t, t), q.ravel()).reshape(2, 2)
    return t, q, 0.0, p


def whiten(z: np.ndarray, structure: str, parameters: np.ndarray) -> tuple[np.ndarray, float]:
    """Standardized innovations of every column (NaN in gaps and where the level is not known yet) and the sum of the logs of their variances."""
    t, q, h, p = _system(structure, parameters)
    a, out, logs, known = np.zeros((len(t), z.shape[1])), np.full(z.shape, np.nan), 0.0, structure != "level"
    for i, row in enumerate(z):
        if i:
            a, p = t @ a, t @ p @ t.T + q
        if np.isnan(row).any():
            continue
        f = p[0, 0] + h
        v = row - a[0]
        if known:
            out[i], logs = v / math.sqrt(f), logs + math.log(f)
        gain = p[:, :1] / f
        a, p, known = a + gain * v, p - gain @ p[:1], True
    return out, logs


class SeriesFit:
    """A regression of y on the columns of x (a constant first, but for a level) with errors of the structure."""

    def __init__(self, y: np.ndarray, x: np.ndarray, structure: str):
        self.structure, self.x = structure, x
        self.z = np.column_stack([y, x])
        self.z[np.isnan(self.z).any(1)] = np.nan
        self.usable = int((~np.isnan(self.z[:, 0])).sum()) > x.shape[1] + STRUCTURES[structure] + 2
        if self.usable:
            self.search()

    def at(self, parameters: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        v, logs = whiten(self.z, self.structure, parameters)
        ok = ~np.isnan(v[:, 0])
        b = np.linalg.lstsq(v[ok, 1:], v[ok, 0], rcond=None)[0]
        e, n = v[ok, 0] - v[ok, 1:] @ b, int(ok.sum())
        s2 = max(float(e @ e) / n, 1e-300)
        return -0.5 * (n * (math.log(2 * math.pi * s2) + 1) + logs), b, v, s2

    def search(self) -> None:
        """The likeliest parameters: a coarse grid, then ever smaller steps about the best."""
        k = STRUCTURES[self.structure]
        grid = np.arange(-10.0, 4.1, 1.0) if self.structure == "level" else np.arange(-2.0, 2.1, 0.5)
        tries = [np.array([g]) for g in grid] if k == 1 else [np.array([a, b]) for a in grid for b in grid]
        best = max(tries, key=lambda p: self.at(p)[0])
        value, step = self.at(best)[0], 0.5
        while step > 1e-5:
            moves = [best + step * d * np.eye(k)[i] for i in range(k) for d in (1, -1)]
            new = max(moves, key=lambda p: self.at(p)[0])
            if (got := self.at(new)[0]) > value + 1e-12:
                best, value = new, got
            else:
                step /= 2
        self.parameters = best
        self.llf, self.beta, v, self.s2 = self.at(best)
        ok = ~np.isnan(v[:, 0])
        self.n = int(ok.sum())
        self.cov = np.linalg.pinv(v[ok, 1:].T @ v[ok, 1:]) * self.s2 * self.n / max(1, self.n - self.x.shape[1])
        self.innovations = np.where(ok, (v[:, 0] - v[:, 1:] @ self.beta) / math.sqrt(self.s2), np.nan)
        self.criterion = aicc(self.llf, self.x.shape[1] + k + 1, self.n)

    def shown(self) -> list[tuple[str, float]]:
        """The structure's parameters in their own units."""
        if self.structure == "level":
            return [("level_variance", math.exp(self.parameters[0]) * self.s2), ("noise_variance", self.s2)]
        if self.structure == "ar1":
            return [("rho1", math.tanh(self.parameters[0])), ("noise_variance", self.s2)]
        a, b = np.tanh(self.parameters)
        return [("rho1", float(a * (1 - b))), ("rho2", float(b)), ("noise_variance", self.s2)]

    def roots(self) -> list[float]:
        """Moduli of the errors' autoregression; under one: stable."""
        return ar_roots([v for n, v in self.shown() if n.startswith("rho")])

    def ahead(self, x: np.ndarray) -> float:
        """Expected y of the month after the last, with regressors x."""
        t, q, h, p = _system(self.structure, self.parameters)
        e, a = self.z[:, 0] - self.z[:, 1:] @ self.beta, np.zeros(len(t))
        for i, v in enumerate(e):
            if i:
                a, p = t @ a, t @ p @ t.T + q
            if not np.isnan(v):
                gain = p[:, 0] / (p[0, 0] + h)
                a, p = a + gain * (v - a[0]), p - np.outer(gain, p[0])
        return float((t @ a)[0] + x @ self.beta)


def likelihood_ratio(full: float, less: float, extra: int) -> tuple[float, float]:
    """Statistic and p of a fit against a nested one with `extra` parameters less."""
    stat = max(0.0, 2 * (full - less))
    return stat, chi2_tail(stat, extra)


def wald(estimates: np.ndarray, cov: np.ndarray) -> tuple[float, float]:
    """Statistic and p of several coefficients being zero together."""
    stat = float(estimates @ np.linalg.pinv(cov) @ estimates)
    return stat, chi2_tail(stat, len(estimates))


def diagnostics(innovations: np.ndarray, lags: int) -> dict:
    """Of standardized innovations: mean, variance, Ljung-Box over calendar lags, skewness and kurtosis test, and the variance of the last third over the first."""
    ok = ~np.isnan(innovations)
    v = innovations[ok]
    n = len(v)
    d = np.where(ok, innovations - (v.mean() if n else 0), np.nan)
    total, q, df = float((d[ok] ** 2).sum()), 0.0, 0
    for h in range(1, lags + 1):
        pair = d[h:] * d[:-h]
        if (~np.isnan(pair)).sum() > 2 and total > 0 and n > h:
            q, df = q + n * (n + 2) * (np.nansum(pair) / total) ** 2 / (n - h), df + 1
    m2 = total / n if n else math.nan
    skew, kurt = (float((d[ok] ** 3).mean() / m2**1.5), float((d[ok] ** 4).mean() / m2**2)) if n and m2 > 0 else (math.nan, math.nan)
    jb = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4) if n else math.nan
    third = n // 3
    first, last = (float((v[:third] ** 2).sum()), float((v[n - third :] ** 2).sum())) if third else (0.0, 0.0)
    return {"n": n, "mean": float(v.mean()) if n else None, "variance": m2, "ljung_box": q, "ljung_box_df": df, "ljung_box_p": chi2_tail(q, df) if df else None, "jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2) if jb == jb else None, "variance_ratio": last / first if first else None}


TABLE = "structure string, term string, estimate double, std_error double, n long, llf double, aicc double, joint_lr double, joint_lr_p double, joint_wald double, joint_wald_p double, stable boolean"
CHECKS = "n long, mean double, variance double, ljung_box double, ljung_box_df long, ljung_box_p double, jarque_bera double, jarque_bera_p double, variance_ratio double"


def _series(pdf: pd.DataFrame, xs: list[str], structure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Months without a break, the response and the regressors; NaN in months that are not there."""
    pdf = pdf.drop_duplicates("mi").set_index("mi").sort_index()
    months = np.arange(pdf.index.min(), pdf.index.max() + 1)
    full = pdf.reindex(months)
    x = full[xs].to_numpy(float)
    return months, full["y"].to_numpy(float), x if structure == "level" else np.column_stack([np.ones(len(months)), x])


def _rows(df: DataFrame, keys: list[str], y: str, xs: list[str], month: str) -> DataFrame:
    return df.filter(F.col(month).isNotNull()).select(*keys, month_index(F.col(month)).alias("mi"), F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(x) for x in xs))


def _schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string(more).fields])


def state_space(df: DataFrame, keys: list[str], y: str, xs: list[str], structure: str = "ar1", month: str = "month") -> DataFrame:
    """Every series' coefficients and structure parameters, and whether its regressors matter together (against the fit without them).

    A month that is absent or lacks a value is a gap that the filter runs over. Series too short for the fit give no rows.
    """
    rows = _rows(df, keys, y, xs, month)
    names = [f.name for f in T._parse_datatype_string(TABLE).fields]

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, x = _series(pdf, xs, structure)
        own = SeriesFit(values, x, structure)
        if not own.usable:
            return pd.DataFrame([], columns=[*keys, *names])
        first = x.shape[1] - len(xs)
        lr = w = (None, None)
        if xs:
            masked = np.where(np.isnan(own.z[:, 0]), np.nan, values)  # both on the same months
            less = SeriesFit(masked, x[:, :first], structure)
            lr, w = likelihood_ratio(own.llf, less.llf, len(xs)), wald(own.beta[first:], own.cov[first:, first:])
        se = np.sqrt(np.maximum(np.diag(own.cov), 0))
        terms = [*(["one"] if first else []), *xs]
        stable = all(r < 1 for r in own.roots())
        got = [(t, float(b), float(s)) for t, b, s in zip(terms, own.beta, se)] + [(t, float(v), None) for t, v in own.shown()]
        return pd.DataFrame([(*key, structure, *g, own.n, own.llf, own.criterion, *lr, *w, stable) for g in got], columns=[*keys, *names])

    return rows.groupBy(*keys).applyInPandas(fit, _schema(rows, keys, TABLE))


def innovation_checks(df: DataFrame, keys: list[str], y: str, xs: list[str], structure: str = "ar1", lags: int = 12, month: str = "month") -> DataFrame:
    """Diagnostics of every series' standardized innovations."""
    rows = _rows(df, keys, y, xs, month)
    names = [f.name for f in T._parse_datatype_string(CHECKS).fields]

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, x = _series(pdf, xs, structure)
        own = SeriesFit(values, x, structure)
        got = [tuple(diagnostics(own.innovations, lags).values())] if own.usable else []
        return pd.DataFrame([(*key, *g) for g in got], columns=[*keys, *names])

    return rows.groupBy(*keys).applyInPandas(fit, _schema(rows, keys, CHECKS))


def rolling_forecasts(df: DataFrame, keys: list[str], y: str, xs: list[str], structure: str = "ar1", least_months: int = 24, month: str = "month") -> DataFrame:
    """One-month-ahead forecasts from every origin with least_months observed months behind it: keys, target (month), observed, forecast. No regressors: the null forecast.

    A series without a forecast has one row with nulls."""
    rows = _rows(df, keys, y, xs, month)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        months, values, x = _series(pdf, xs, structure)
        out, seen = [], np.cumsum(~np.isnan(values))
        for i in range(len(months) - 1):
            if seen[i] < least_months or np.isnan(values[i + 1]) or np.isnan(x[i + 1]).any():
                continue
            own = SeriesFit(values[: i + 1], x[: i + 1], structure)
            if own.usable:
                out.append((*key, int(months[i + 1]), float(values[i + 1]), own.ahead(x[i + 1])))
        return pd.DataFrame(out or [(*key, None, None, None)], columns=[*keys, "mi", "observed", "forecast"])

    got = rows.groupBy(*keys).applyInPandas(fit, _schema(rows, keys, "mi int, observed double, forecast double"))
    return got.select(*keys, month_of_index(F.col("mi")).alias("target"), "observed", "forecast")
