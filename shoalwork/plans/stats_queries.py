"""Queries over regressions, resampling, panels with autoregressive errors and state-space fits, with SQL where SQL can tell.

A parameter search (state space, splines' F tests, autoregressive errors) has no SQL; tests hold those against numpy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel_ar as par
from ..operators import resampling, smooth, state_space, stats
from . import bindings as b
from .registry import query, rounded
from .scene_queries import REG, regression_rows

PLAN = """span AS (SELECT min(mi) AS a, max(mi) AS z FROM z),
    h1 AS (SELECT r, d, a, z, (r::BIGINT * 48271 + d::BIGINT * 69621 + 12345) % 2147483647 AS h FROM span, generate_series(0, {reps} - 1) t(r), generate_series(0, CAST(ceil((z - a + 1) / 6.0) AS INT) - 1) u(d)),
    h2 AS (SELECT *, (h * h + 1442695) % 2147483647 AS g FROM h1), plan AS (SELECT r, a + ((g * g + h) % 2147483647) % greatest(z - a - 4, 1) + k AS mi FROM h2, generate_series(0, 5) v(k))"""


@query(f"""WITH {REG}, {PLAN.format(reps=200)}, s AS (SELECT mi, sum(y) AS s, count(y) AS n FROM z GROUP BY 1), m AS (SELECT r, sum(s) / sum(n) AS m FROM plan JOIN s USING (mi) GROUP BY 1)
    SELECT count(*) AS replicates, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std_error, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_interval(spark, sf):
    return rounded(resampling.bootstrap_mean(regression_rows(spark, sf), "y", 6, 200), mean=6, std_error=6, low=6, high=6)


@query(f"""WITH {REG}, {PLAN.format(reps=100)}, s AS (SELECT mi, count(*) AS n, sum(x1) AS x, sum(y) AS y, sum(x1 * x1) AS xx, sum(x1 * y) AS xy FROM z GROUP BY 1), t AS (SELECT r, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM plan JOIN s USING (mi) GROUP BY 1),
    c AS (SELECT r, (n * xy - x * y) / (n * xx - x * x) AS b FROM t), e AS (SELECT 'x1' AS term, b FROM c UNION ALL SELECT 'one', (y - b * x) / n FROM t JOIN c USING (r))
    SELECT term, count(*) AS replicates, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std_error, round(quantile_cont(b, 0.025), 6) AS low, round(quantile_cont(b, 0.975), 6) AS high, round(avg((b > 0)::INT), 6) AS share_positive FROM e GROUP BY 1""")
def bootstrap_coefficients(spark, sf):
    got = resampling.bootstrap_coefficients(regression_rows(spark, sf), "y", ["x1"], 6, 100)
    return rounded(resampling.summary(got, "estimate", ["term"]), mean=6, std_error=6, low=6, high=6, share_positive=6)


@query(f"""WITH {REG}, {PLAN.format(reps=100)}, s AS (SELECT mi, sum((y - x1) ** 2) AS a, sum((y - x2) ** 2) AS b, count(*) AS n FROM z GROUP BY 1), m AS (SELECT r, sqrt(sum(a) / sum(n)) - sqrt(sum(b) / sum(n)) AS d FROM plan JOIN s USING (mi) GROUP BY 1)
    SELECT round((SELECT sqrt(avg((y - x1) ** 2)) - sqrt(avg((y - x2) ** 2)) FROM z), 6) AS observed, count(*) AS replicates, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std_error, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d > 0)::INT), 6) AS share_positive FROM m""")
def bootstrap_rmse_difference(spark, sf):
    rows = regression_rows(spark, sf).withColumns({"a": F.col("y") - F.col("x1"), "b": F.col("y") - F.col("x2")})
    return rounded(resampling.bootstrap_rmse_difference(rows, "a", "b", 6, 100), observed=6, mean=6, std_error=6, low=6, high=6, share_positive=6)


@query(f"""WITH {REG}, {PLAN.format(reps=100)}, s AS (SELECT mi, count(*) AS n, sum(x1) AS x, sum(y) AS y, sum(x1 * x1) AS xx, sum(x1 * y) AS xy FROM z GROUP BY 1), t AS (SELECT r, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM plan JOIN s USING (mi) GROUP BY 1),
    c AS (SELECT xy / n - x * y / n / n AS cov, sqrt(xx / n - x * x / n / n) AS sd FROM t), e AS (SELECT sign(cov) * greatest(abs(cov / sd) - 0.002 * 0.5, 0) / (1 + 0.002 * 0.5) / sd AS b FROM c)
    SELECT 'x1' AS term, round(avg((abs(b) > 1e-12)::INT), 6) AS frequency, round(avg(b), 6) AS mean FROM e""")
def stability_selection(spark, sf):
    return rounded(resampling.stability_selection(regression_rows(spark, sf), "y", ["x1"], 0.002, 0.5, 6, 100), frequency=6, mean=6)


@query(f"""WITH {REG}, s AS (SELECT mi, count(*) AS n, sum(x1) AS x, sum(y) AS y, sum(x1 * x1) AS xx, sum(x1 * y) AS xy, sum(y * y) AS yy FROM z GROUP BY 1),
    f AS (SELECT mi, n AS tn, x AS tx, y AS ty, xx AS txx, xy AS txy, yy AS tyy, count(*) OVER w AS months, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM s WINDOW w AS (ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT *, xy / n - x * y / n / n AS cov, sqrt(xx / n - x * x / n / n) AS sd FROM f, (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (0.0, 0.5), (0.002, 1.0), (0.002, 0.5)) q(penalty, ratio) WHERE months >= 24),
    e AS (SELECT *, sign(cov) * greatest(abs(cov / sd) - penalty * ratio, 0) / (1 + penalty * (1 - ratio)) / sd AS b FROM p), c AS (SELECT *, y / n - b * x / n AS k FROM e)
    SELECT penalty, ratio, CAST(sum(tn) AS BIGINT) AS n, round(sqrt(sum(tyy - 2 * k * ty - 2 * b * txy + k * k * tn + 2 * k * b * tx + b * b * txx) / sum(tn)), 6) AS rmse FROM c GROUP BY 1, 2""")
def net_path(spark, sf):
    return rounded(resampling.net_path(regression_rows(spark, sf), "y", ["x1"], [0.0, 0.002], [1.0, 0.5]), rmse=6)


@query(f"""WITH {REG}, t AS (SELECT *, sin(month(month) * 2 * pi() / 12) AS s, cos(month(month) * 2 * pi() / 12) AS c FROM z), r AS (SELECT 'x1' AS driver, corr(x1, s) AS a, corr(x1, c) AS b, corr(s, c) AS m, corr(x1, mi) AS t FROM t UNION ALL SELECT 'x2', corr(x2, s), corr(x2, c), corr(s, c), corr(x2, mi) FROM t)
    SELECT driver, round((a * a + b * b - 2 * a * b * m) / (1 - m * m), 6) AS r2_season, round(t * t, 6) AS r2_trend FROM r""")
def identifiability_audit(spark, sf):
    return rounded(resampling.identifiability(regression_rows(spark, sf), ["x1", "x2"], 1).select("driver", "r2_season", "r2_trend"), r2_season=6, r2_trend=6)


@query(f"""WITH {REG}, s AS (SELECT (q.y - p.y) / (q.x1 - p.x1) AS k FROM z p JOIN z q ON p.x1 < q.x1), m AS (SELECT median(k) AS slope FROM s)
    SELECT round(slope, 6) AS slope, round((SELECT median(y - slope * x1) FROM z), 6) AS intercept, (SELECT count(*) FROM z) AS n FROM m""")
def theil_sen(spark, sf):
    return rounded(stats.theil_sen(regression_rows(spark, sf), "x1", "y"), slope=6, intercept=6)


SANDWICH = """f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx FROM z), e AS (SELECT mi, y - a - b * x1 AS e, x1 AS x FROM z, f),
    own AS (SELECT sum(e * e) AS m00, sum(e * e * x) AS m01, sum(e * e * x * x) AS m11, sum(e * e) AS rss FROM e), s AS (SELECT mi, sum(e) AS s0, sum(e * x) AS s1 FROM e GROUP BY 1)"""


@query(f"""WITH {REG}, {SANDWICH}, c AS (SELECT sum((1 - (p.mi - q.mi) / 4.0) * 2 * p.s0 * q.s0) AS c00, sum((1 - (p.mi - q.mi) / 4.0) * (p.s0 * q.s1 + p.s1 * q.s0)) AS c01, sum((1 - (p.mi - q.mi) / 4.0) * 2 * p.s1 * q.s1) AS c11 FROM s p JOIN s q ON p.mi - q.mi BETWEEN 1 AND 3),
    g AS (SELECT a, b, n, sxx / d AS b00, -sx / d AS b01, n / d AS b11, m00 + c00 AS m00, m01 + c01 AS m01, m11 + c11 AS m11 FROM f, own, c, (SELECT n * sxx - sx * sx AS d FROM f))
    SELECT 'one' AS term, round(a, 6) AS estimate, round(sqrt((b00 * b00 * m00 + 2 * b00 * b01 * m01 + b01 * b01 * m11) * n / (n - 2)), 6) AS std_error FROM g
    UNION ALL SELECT 'x1', round(b, 6), round(sqrt((b01 * b01 * m00 + 2 * b01 * b11 * m01 + b11 * b11 * m11) * n / (n - 2)), 6) FROM g""")
def hac_regression(spark, sf):
    return rounded(stats.hac(regression_rows(spark, sf), "y", ["x1"], 3), estimate=6, std_error=6)


@query(f"""WITH {REG}, {SANDWICH}, g AS (SELECT a, b, n, rss / (n - 2) AS v, n * sxx - sx * sx AS d, n AS k, sxx FROM f, own)
    SELECT 'one' AS term, round(sqrt(v * sxx / d), 6) AS std_error, round(a / sqrt(v * sxx / d), 4) AS t FROM g UNION ALL SELECT 'x1', round(sqrt(v * k / d), 6), round(b / sqrt(v * k / d), 4) FROM g""")
def ols_standard_errors(spark, sf):
    return rounded(stats.ols(regression_rows(spark, sf), "y", ["x1"]).select("term", "std_error", "t"), std_error=6, t=4)


@query(f"""WITH {REG}, {SANDWICH}, g AS (SELECT a, b, rss / (n - 2) AS v, n * sxx - sx * sx AS d, n AS k FROM f, own)
    SELECT 'x1' AS term, round(b - 1.959963984540054 * sqrt(v * k / d), 6) AS low, round(b + 1.959963984540054 * sqrt(v * k / d), 6) AS high FROM g""")
def coefficient_intervals(spark, sf):
    return rounded(stats.coefficient_table(stats.ols(regression_rows(spark, sf), "y", ["x1"])).select("term", "low", "high"), low=6, high=6)


# --- panels: without lags, season and trend the model is the regression within regions, which SQL can tell ------------------

WITHIN = """w AS (SELECT *, y - avg(y) OVER (PARTITION BY cell) AS dy, x1 - avg(x1) OVER (PARTITION BY cell) AS dx FROM z)"""
PLAIN = {"order": 0, "harmonics": 0, "trend": False}


@query(f"""WITH {REG}, {WITHIN}, f AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS ss, count(*) AS n, count(DISTINCT cell) AS r, count(DISTINCT mi) AS g FROM w), s AS (SELECT mi, sum(dx * (dy - b * dx)) AS s FROM w, f GROUP BY 1)
    SELECT 'x1' AS term, round(b, 6) AS estimate, round(sqrt(sum(s * s)) / any_value(ss) * sqrt(any_value(g) / (any_value(g) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - any_value(r) - 1.0)), 6) AS std_error, any_value(n) AS n, any_value(g) AS n_clusters FROM s, f GROUP BY b""")
def panel_within(spark, sf):
    got = par.panel_ar(regression_rows(spark, sf), "cell", "y", ["x1"], **PLAIN).filter("kind = 'driver'")
    return rounded(got.select("term", "estimate", "std_error", "n", "n_clusters"), estimate=6, std_error=6)


@query(f"""WITH {REG}, {WITHIN}, f AS (SELECT sum(dx * dy) / sum(dx * dx) AS b FROM w) SELECT CAST(cell AS VARCHAR) AS region, month, round(y, 6) AS y, round(dy - b * dx, 6) AS residual FROM w, f""")
def panel_residuals(spark, sf):
    return rounded(par.panel_residuals(regression_rows(spark, sf), "cell", "y", ["x1"], **PLAIN).select("region", "month", "y", "residual"), y=6, residual=6)


@query(f"""WITH {REG}, {WITHIN}, f AS (SELECT cell, sum(dx * dy) AS xy, sum(dx * dx) AS xx FROM w GROUP BY 1) SELECT CAST(cell AS VARCHAR) AS left_out, 'x1' AS term, round(((SELECT sum(xy) FROM f) - xy) / ((SELECT sum(xx) FROM f) - xx), 6) AS estimate FROM f""")
def without_each_region(spark, sf):
    return rounded(par.without_each_region(regression_rows(spark, sf), "cell", "y", ["x1"], **PLAIN).select("left_out", "term", "estimate"), estimate=6)


@query(f"""WITH {REG}, m AS (SELECT DISTINCT mi FROM z), c AS (SELECT mi AS origin, count(*) OVER (ORDER BY mi) AS n_months FROM m) SELECT CAST(origin AS INT) AS origin, n_months FROM c WHERE n_months >= 24 AND origin + 1 IN (SELECT mi FROM m)""")
def feasible_origins(spark, sf):
    return par.feasible_origins(regression_rows(spark, sf))


@query(f"""WITH {REG}, m AS (SELECT DISTINCT mi FROM z), o AS (SELECT origin FROM (SELECT mi AS origin, count(*) OVER (ORDER BY mi) AS k FROM m) WHERE k >= 72 AND origin + 1 IN (SELECT mi FROM m)),
    t AS (SELECT origin, cell, y, x1, avg(y) OVER p AS my, avg(x1) OVER p AS mx FROM z JOIN o ON mi <= origin WINDOW p AS (PARTITION BY origin, cell)), f AS (SELECT origin, sum((x1 - mx) * (y - my)) / sum((x1 - mx) ** 2) AS b FROM t GROUP BY 1), r AS (SELECT DISTINCT origin, cell, my, mx FROM t),
    g AS (SELECT z.*, o.origin FROM z JOIN o ON mi = origin + 1)
    SELECT g.month AS target, CAST(g.cell AS VARCHAR) AS region, round(g.y, 6) AS observed, round(my, 6) AS plain, round(my + b * (g.x1 - mx), 6) AS "full", round(p.y, 6) AS persistence, round(s.y, 6) AS seasonal
    FROM g LEFT JOIN r ON r.origin = g.origin AND r.cell = g.cell LEFT JOIN f ON f.origin = g.origin LEFT JOIN z p ON p.cell = g.cell AND p.mi = g.mi - 1 LEFT JOIN z s ON s.cell = g.cell AND s.mi = g.mi - 12""")
def one_month_forecasts(spark, sf):
    got = par.one_month_forecasts(regression_rows(spark, sf), "cell", "y", ["x1"], least_months=72, **PLAIN)
    return rounded(got.select("target", "region", "observed", "plain", "full", "persistence", "seasonal"), observed=6, plain=6, full=6, persistence=6, seasonal=6)


def _ar1_sql(rounds: int = 20) -> str:
    """Rounds of least squares on differenced rows within cells and of the autoregression of what they leave, one after the other."""
    steps = ["r0 AS (SELECT 0.0::DOUBLE AS rho)"]
    for k in range(rounds):
        steps += [
            f"d{k} AS (SELECT *, y - rho * ly AS dy, x - rho * lx AS dx FROM s, r{k})",
            f"w{k} AS (SELECT *, avg(dy) OVER (PARTITION BY cell) AS my, avg(dx) OVER (PARTITION BY cell) AS mx FROM d{k})",
            f"b{k} AS (SELECT sum((dx - mx) * (dy - my)) / sum((dx - mx) ** 2) AS b FROM w{k})",
            f"u{k} AS (SELECT deep, y - b * x - (my - b * mx) / (1 - rho) AS u, ly - b * lx - (my - b * mx) / (1 - rho) AS lu FROM w{k}, b{k})",
            f"r{k + 1} AS (SELECT sum(u * lu) / sum(lu * lu) AS rho FROM u{k} WHERE deep)",
        ]
    last = rounds - 1
    return f"""WITH {REG}, one AS (SELECT cell, mi, y, x1 AS x FROM z), s AS MATERIALIZED (
        SELECT o.*, p.y AS ly, p.x AS lx, q.y IS NOT NULL AS deep FROM one o JOIN one p ON p.cell = o.cell AND p.mi = o.mi - 1 LEFT JOIN one q ON q.cell = o.cell AND q.mi = o.mi - 2),
        {", ".join(t.replace(" AS (", " AS MATERIALIZED (", 1) for t in steps)}
        SELECT 'x1' AS term, round(b, 5) AS estimate, (SELECT count(*) FROM s) AS n FROM b{last} UNION ALL SELECT 'rho1', round(rho, 5), (SELECT count(*) FROM s) FROM r{rounds}"""


@query(_ar1_sql())
def panel_ar1(spark, sf):
    got = par.panel_ar(regression_rows(spark, sf), "cell", "y", ["x1"], 1, harmonics=0, trend=False).filter("kind in ('driver', 'errors')")
    return rounded(got.select("term", "estimate", "n"), estimate=5)


@query()
def ar_regression(spark, sf):
    return par.panel_ar(regression_rows(spark, sf), "cell", "y", ["x1", "x2"], 1)


@query()
def ar_orders(spark, sf):
    return par.order_table(regression_rows(spark, sf), "cell", "y", ["x1"])


@query()
def additive_splines(spark, sf):
    return smooth.additive(regression_rows(spark, sf), "y", {"x1": 4}, ["x2"])


@query()
def state_space_fits(spark, sf):
    return state_space.state_space(regression_rows(spark, sf), ["cell"], "y", ["x1"], "ar1")


@query()
def innovation_checks(spark, sf):
    return state_space.innovation_checks(regression_rows(spark, sf), ["cell"], "y", [], "level", 6)


@query()
def rolling_null_forecasts(spark, sf):
    return state_space.rolling_forecasts(regression_rows(spark, sf), ["cell"], "y", [], "ar1", 30)
