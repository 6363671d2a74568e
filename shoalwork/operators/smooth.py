"""Smooth terms: natural cubic splines as column expressions, additive fits on them and nested F tests, all from one matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import complete, gram, solve


def knots(df: DataFrame, x: str, n: int) -> list[float]:
    """n distinct values at even quantiles of a column, its least and largest among them."""
    row = df.filter(F.col(x).isNotNull()).agg(F.percentile_approx(F.col(x).cast("double"), [i / (n - 1) for i in range(n)], 10_000)).first()
    return sorted(set(row[0] or []))


def natural_spline(x: Column, at: list[float]) -> list[Column]:
    """Columns that span, with a constant, the cubic splines with these knots that are straight lines beyond them.

    As many columns as knots less one; the first is x itself. Scaled by the knots' span, so that cubes stay small.
    """
    low, span = at[0], (at[-1] - at[0]) or 1.0
    z = (x.cast("double") - low) / span
    k = [(v - low) / span for v in at]

    def cube(v: float) -> Column:
        return F.pow(F.greatest(z - v, F.lit(0.0)), F.lit(3.0))

    def bend(i: int) -> Column:
        return (cube(k[i]) - cube(k[-1])) / (k[-1] - k[i])

    return [z, *(bend(i) - bend(len(k) - 2) for i in range(len(k) - 2))]


def f_tail(f: float, d1: int, d2: int) -> float:
    """Chance of an F value at least so large, by the continued fraction of the incomplete beta function."""
    if not (f > 0 and d1 > 0 and d2 > 0):
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + top * d or 1e-300), 1 + top / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return min(1.0, front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b)


def additive(df: DataFrame, y: str, smooth: dict[str, int], linear: list[str] = (), weight: str | None = None) -> DataFrame:
    """A fit of y on a spline of each smooth term (term: number of knots) and on linear terms, and what each adds.

    Returns term, kind, columns, semi_partial_r2, f, p (of the fit with the term against the fit without), nonlinear_f and nonlinear_p (of the spline against
    a straight line; null for linear terms), full_r2 and n. One pass for the knots, one for all fits.
    """
    rows = complete(df, [y, *smooth, *linear, *([weight] if weight else [])])
    names, groups = [], {}
    for term, n in smooth.items():
        columns = natural_spline(F.col(term), knots(rows, term, n))
        groups[term] = [f"_{term}_{i}" for i in range(len(columns))]
        rows = rows.withColumns(dict(zip(groups[term], columns)))
        names += groups[term]
    for term in linear:
        groups[term] = [term]
        names.append(term)
    g, order, n = gram(rows, y, names, weight)
    every = list(range(len(order) - 1))

    def residual(keep: list[int]) -> tuple[float, float]:
        beta, r2 = solve(g, keep)
        return max(0.0, float(g[-1, -1] - beta @ g[np.array(keep), -1])), r2

    rss, r2 = residual(every)
    left = n - len(every)

    def test(dropped: list[str]) -> tuple[float, float, float] | tuple[None, None, None]:
        if not dropped or left <= 0 or rss <= 0:
            return None, None, None
        less, r2_less = residual([i for i in every if order[i] not in dropped])
        f = max(0.0, (less - rss) / len(dropped) / (rss / left))
        return f, f_tail(f, len(dropped), left), r2 - r2_less

    out = []
    for term, columns in groups.items():
        f, p, gain = test(columns)
        bent = test(columns[1:]) if term in smooth else (None, None, None)
        out.append((term, "smooth" if term in smooth else "linear", len(columns), gain, f, p, bent[0], bent[1], r2, n))
    return df.sparkSession.createDataFrame(out, "term string, kind string, columns int, semi_partial_r2 double, f double, p double, nonlinear_f double, nonlinear_p double, full_r2 double, n long")
