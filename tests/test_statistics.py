"""Regressions, resampling and state-space fits against plain numpy, and catalogue edges."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoalwork.functions import columns as fn
from shoalwork.operators import catalog, metrics, panel_ar, resampling, smooth, state_space, stats
from shoalwork.plans import helper_queries, pixel_queries, registry, scene_queries

from .panel_fit import PanelFit


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def panel_rows(regions=4, months=60, rho=0.6, seed=3, skip=7):
    r, out = np.random.default_rng(seed), []
    for g in range(regions):
        e = 0.0
        for m in range(months):
            e = rho * e + r.normal(0, 0.2)
            x = float(r.normal())
            y = g + 0.5 * math.sin(2 * math.pi * (m % 12 + 1) / 12) + 0.02 * m + 0.8 * x + e
            if (g + m) % skip:
                out.append((f"r{g}", 24000 + m, y, x))
    return pd.DataFrame(out, columns=["region", "mi", "y", "x"])


def test_median_slope_by_counting_equals_all_pairs():
    r = np.random.default_rng(5)
    for n in (2, 3, 60, 301):
        x, y = np.round(r.normal(size=n), 1), np.round(r.normal(size=n), 1)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        i, j = np.triu_indices(n, 1)
        ok = x[j] != x[i]
        slopes = (y[j] - y[i])[ok] / (x[j] - x[i])[ok]
        for at in (-1.2345678, -0.0512345, 0.0131234, 0.7123456):  # no pair has these, so rounding decides nothing
            assert stats.slopes_up_to(x, y, at) == (slopes <= at).sum()
        if ok.any():
            assert stats.median_slope(x, y) == pytest.approx(np.median(slopes))
    x = r.normal(size=2400)
    y = 2 * x + r.normal(size=2400)
    i, j = np.triu_indices(2400, 1)
    assert stats.median_slope(x, y) == pytest.approx(np.median((y[j] - y[i]) / (x[j] - x[i])), abs=1e-9)
    assert math.isnan(stats.median_slope(np.ones(4), np.arange(4.0)))


def test_turned_pairs_by_weight():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 40):
        place, z, w = r.integers(0, 6, n), r.integers(0, 5, n), r.integers(1, 4, n)
        assert stats.turned(place, z, w) == sum(w[i] * w[j] for i in range(n) for j in range(n) if place[i] < place[j] and z[i] >= z[j])


@pytest.mark.parametrize("kind", ["ties", "one x"])
def test_median_slope_over_blocks(spark, monkeypatch, kind):
    """Many blocks, against all pairs at once; repeated points, an x that holds a third of the rows, levels that many points share."""
    monkeypatch.setattr(stats, "AT_ONCE", 50)
    monkeypatch.setattr(stats, "BLOCK_ROWS", 60)
    r = np.random.default_rng(7)
    x, y = r.normal(size=250), r.normal(size=250)
    if kind == "ties":
        x, y = np.round(x, 1), np.round(y + x, 0)
        x[:85], y[100:120], x[100:120] = 0.5, 1.0, 0.7
    else:
        x[:] = 2.0
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, float("nan"))], "x double, y double").repartition(3)
    got = stats.theil_sen(df, "x", "y").first()
    want = stats.median_slope(x, y)
    assert got.n == 250
    if kind == "one x":
        assert math.isnan(got.slope) and math.isnan(got.intercept)
    else:
        assert got.slope == pytest.approx(want, rel=1e-9, abs=1e-12) and got.intercept == pytest.approx(np.median(y - want * x), rel=1e-9)
        assert stats.theil_sen(df, "x", "y", most=30).first().n == 30


def test_exact_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0] * 7 + [1.0, 9.0], list(map(float, range(101)))):
        assert stats.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", len(values)) == np.median(values)


def test_panel_without_lags_is_least_squares():
    rows = panel_rows()
    fit = PanelFit(rows, ["x"], 0)
    d = rows.sort_values(["region", "mi"])
    turn = 2 * np.pi * (d.mi % 12 + 1) / 12
    x = np.column_stack([*((d.region == r).astype(float) for r in sorted(d.region.unique())), *(f(k * turn) for k in (1, 2) for f in (np.sin, np.cos)), (d.mi - 24000) / 12, d.x])
    beta = np.linalg.lstsq(x, d.y, rcond=None)[0]
    assert fit.beta == pytest.approx(beta)
    e = d.y - x @ beta
    s = np.array([(x[d.mi == m] * e[d.mi == m].to_numpy()[:, None]).sum(0) for m in sorted(d.mi.unique())])
    bread, g, (n, k) = np.linalg.inv(x.T @ x), len(s), x.shape
    assert fit.cov == pytest.approx(bread @ s.T @ s @ bread * g / (g - 1) * (n - 1) / (n - k))


def test_panel_lags_are_calendar_lags():
    rows = panel_rows(regions=2, months=8, skip=4)
    fit = PanelFit(rows, [], 1, harmonics=0, trend=False)
    known = {(r, m): i for i, (r, m) in enumerate(zip(fit.region, fit.mi))}
    assert fit.back[1].tolist() == [known.get((r, m - 1), -1) for r, m in zip(fit.region, fit.mi)]
    assert (fit.back[1][fit.sample] >= 0).all()


def test_panel_errors_and_forecast():
    rows = panel_rows(regions=6, months=120)
    fit = PanelFit(rows, ["x"], 1)
    assert fit.rho[0] == pytest.approx(0.6, abs=0.08) and fit.beta[-1] == pytest.approx(0.8, abs=0.03)
    ahead = pd.DataFrame({"region": ["r0", "r1", "new"], "mi": [24120] * 3, "x": [0.0, 1.0, 0.0]})
    got, used = fit.forecast(ahead)
    level = fit.design(np.array([0, 1]), np.array([24120] * 2), np.array([[0.0], [1.0]])) @ fit.beta
    left = {(int(r), int(m)): e for r, m, e in zip(fit.region, fit.mi, fit.residuals())}
    for i in (0, 1):
        e = left.get((i, 24119), float("nan"))
        assert used[i] == (0 if math.isnan(e) else 1) and got[i] == pytest.approx(level[i] + (0 if math.isnan(e) else fit.rho[0] * e))
    assert math.isnan(got[2])


def test_panel_tables(spark):
    df = spark.createDataFrame([(r.region, month(r.mi - 24000), r.y, r.x) for r in panel_rows(months=48).itertuples()], "region string, month date, y double, x double")
    orders = panel_ar.order_table(df, "region", "y", ["x"], 2).collect()
    assert len(orders) == 3 and len({r.n for r in orders}) == 1 and [r.order for r in orders if r.chosen] == [1]
    got = panel_ar.one_month_forecasts(df, "region", "y", ["x"], least_months=40).collect()
    assert {r.origin for r in got} <= {month(m) for m in range(39, 47)} and all(r.target > r.origin for r in got)
    assert all(r.full is not None and r.plain is not None for r in got)
    empty = panel_ar.panel_ar(df.limit(0), "region", "y", ["x"])
    assert empty.count() == 0 and panel_ar.one_month_forecasts(df.limit(3), "region", "y", ["x"]).count() == 0


def test_state_space_recovers_errors_over_gaps():
    r = np.random.default_rng(2)
    e, x = 0.0, r.normal(size=300)
    y = np.empty(300)
    for i in range(300):
        e = 0.7 * e + r.normal(0, 0.5)
        y[i] = 2.0 + 1.5 * x[i] + e
    y[40:44] = np.nan
    fit = state_space.SeriesFit(y, np.column_stack([np.ones(300), x]), "ar1")
    assert dict(fit.shown())["rho1"] == pytest.approx(0.7, abs=0.1) and fit.beta[1] == pytest.approx(1.5, abs=0.1) and fit.n == 296
    less = state_space.SeriesFit(y, np.ones((300, 1)), "ar1")
    assert state_space.likelihood_ratio(fit.llf, less.llf, 1)[1] < 1e-6 and state_space.wald(fit.beta[1:], fit.cov[1:, 1:])[1] < 1e-6
    two = state_space.SeriesFit(y, np.column_stack([np.ones(300), x]), "ar2")
    assert two.llf >= fit.llf - 1e-6 and all(v < 1 for v in two.roots())
    checks = state_space.diagnostics(fit.innovations, 6)
    assert checks["n"] == 296 and checks["variance"] == pytest.approx(1, abs=0.05) and checks["ljung_box_p"] > 0.001


def test_state_space_likelihood_is_that_of_the_joint_normal():
    y = np.array([0.3, 1.0, np.nan, 0.2, -0.4, 0.9, 0.1])
    r = 0.6
    v, logs = state_space.whiten(y[:, None], "ar1", np.array([math.atanh(r)]))
    at = np.flatnonzero(~np.isnan(y))
    cov = r ** np.abs(at[:, None] - at[None, :]) / (1 - r * r)
    assert logs == pytest.approx(np.linalg.slogdet(cov)[1]) and np.nansum(v**2) == pytest.approx(y[at] @ np.linalg.solve(cov, y[at]))


def test_local_level_forecast_is_the_level():
    y = np.concatenate([np.full(30, 1.0), np.full(30, 4.0)]) + np.tile([0.05, -0.05], 30)
    fit = state_space.SeriesFit(y, np.zeros((60, 0)), "level")
    assert fit.usable and fit.ahead(np.zeros(0)) == pytest.approx(4.0, abs=0.1)
    y[20:25] = np.nan
    assert state_space.SeriesFit(y, np.zeros((60, 0)), "level").n == 54


def test_state_space_tables(spark):
    r = np.random.default_rng(4)
    rows = [(k, month(i), float(r.normal()), float(r.normal())) for k in "ab" for i in range(40) if i % 9]
    df = spark.createDataFrame(rows, "k string, month date, y double, x double")
    got = state_space.state_space(df, ["k"], "y", ["x"]).collect()
    assert {r.term for r in got} == {"one", "x", "rho1", "noise_variance"} and len(got) == 8 and all(r.joint_lr >= 0 for r in got)
    assert state_space.innovation_checks(df, ["k"], "y", []).count() == 2
    ahead = state_space.rolling_forecasts(df, ["k"], "y", [], "level", 30).collect()
    assert ahead and all(r.observed is not None and r.forecast is not None for r in ahead)
    assert state_space.state_space(df.limit(2), ["k"], "y", ["x"]).count() == 0


def test_natural_splines_bend_between_knots_alone(spark):
    at = [0.0, 1.0, 2.5, 4.0]
    df = spark.createDataFrame([(float(v),) for v in (-3, -2, -1, 0.5, 5, 6, 7)], "x double").select("x", *(c.alias(f"b{i}") for i, c in enumerate(smooth.natural_spline(F.col("x"), at))))
    b = np.array([tuple(r)[1:] for r in df.orderBy("x").collect()])
    assert b.shape[1] == 3 and b[0] - b[1] == pytest.approx(b[1] - b[2]) and b[4] - b[5] == pytest.approx(b[5] - b[6])


def test_additive_fit(spark):
    r = np.random.default_rng(1)
    x, z, u = r.uniform(0, 6, 300), r.normal(size=300), r.normal(size=300)
    y = np.sin(x) + 0.5 * z + r.normal(0, 0.1, 300)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, z, u, y)], "x double, z double, u double, y double")
    got = {t.term: t for t in smooth.additive(df, "y", {"x": 5}, ["z", "u"]).collect()}
    assert got["x"].nonlinear_p < 1e-6 and got["z"].p < 1e-6 and got["u"].p > 0.001 and got["x"].full_r2 > 0.95
    line = {t.term: t for t in smooth.additive(df, "y", {}, ["z"]).collect()}["z"]
    t = {t.term: t for t in stats.ols(df, "y", ["z"]).collect()}["z"].t
    assert line.f == pytest.approx(t * t)
    # tables of the F distribution
    assert smooth.f_tail(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-4) and smooth.f_tail(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-4) and smooth.f_tail(0.0, 3, 3) == 1.0


def test_net_without_penalty_is_least_squares_and_with_much_is_constant():
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 3)) * [1, 10, 0.1]
    y = x @ [1.0, -0.2, 3.0] + 2 + r.normal(0, 0.1, 80)
    z = np.column_stack([np.ones(80), x, y])
    want = np.linalg.lstsq(z[:, :4], y, rcond=None)[0]
    assert resampling.net_from_products(z.T @ z, 0.0, 1.0) == pytest.approx(want, abs=1e-6)
    assert resampling.net_from_products(z.T @ z, 1e6, 1.0) == pytest.approx([y.mean(), 0, 0, 0])


def test_identifiability_of_a_pure_season(spark):
    df = spark.createDataFrame([(month(i), math.sin(2 * math.pi * (i % 12 + 1) / 12), float(i), float((i * 7919) % 101)) for i in range(120)], "month date, s double, t double, n double")
    got = {r.driver: r for r in resampling.identifiability(df, ["s", "t", "n"]).collect()}
    assert got["s"].r2_season == pytest.approx(1) and got["t"].r2_trend == pytest.approx(1) and got["n"].anomaly_share > 0.7


def test_draws_spread_evenly(spark):
    df = spark.createDataFrame([(month(i),) for i in range(60)], "month date")
    plan = resampling.month_blocks(df, 6, 400)
    assert plan.groupBy("replicate").count().filter("count <> 60").count() == 0
    starts = plan.groupBy("replicate", "draw").agg(F.min("mi").alias("s")).groupBy("s").count().collect()
    assert len(starts) == 55 and max(r["count"] for r in starts) < 2 * min(r["count"] for r in starts)


def test_export_names_in_all_forms(spark):
    day = "2020-01-31_to_2020-02-01"
    names = {
        f"a/site_s2_predictors_s2_whlev_temporal_v1_{day}.tif": ("S2", "s2_whlev_temporal_v1", False, False),
        f"site_s2_predictors_s2_whlev_texture_v1_{day}-0000000000-0000008192.TIFF": ("S2", "s2_whlev_texture_v1", True, False),
        f"site_s2_predictors_{day} (1).tif": ("S2", None, False, True),
        f"site_s1_scc_temporal_v1_{day}": ("S1", "s1_scc_temporal_v1", False, False),
        f"site_s1_scc_predictors_{day}.tif": ("S1", None, False, False),
        f"site_s1_predictors_{day}.tif": ("S1", None, False, False),
    }
    bad = [f"site_s2_predictors_v9_{day}.tif", f"site_s1_scc_temporal_v1_{day}.csv", f"other_s1_predictors_{day}.tif", f"site_s1_predictors_{day}-12.tif", None]
    df = catalog.parse_names(spark.createDataFrame([(n,) for n in [*names, *bad]], "path string"))
    got = {r.path: r for r in df.collect()}
    for n, (sensor, token, tile, copy) in names.items():
        r = got[n]
        assert (r.sensor, r.token, r.is_tile, r.is_copy) == (sensor, token, tile, copy) and r.start_date == dt.date(2020, 1, 31) and r.prefix.endswith(day), n
    assert all(got[n].prefix is None and got[n].sensor is None for n in bad)


def test_run_log_twins(spark):
    log = spark.createDataFrame([("Completed", "p1", "d/x_local_rf.tif", "nan"), ("done ", "p2", "y_local_rf_patch_cleaned.tif", "r.tif"), ("failed", "p3", "z.tif", "")], "status string, prefix string, model_tif string, rule_tif string")
    got = {r.file_name for r in catalog.run_log_names(log, ("completed", "done")).collect()}
    assert got == {"x_local_rf.tif", "x_local_rf_patch_cleaned.tif", "p1_local_rules.tif", "y_local_rf_patch_cleaned.tif", "y_local_rf.tif", "r.tif", "p2_local_rules.tif"}


def test_tokens_must_agree():
    catalog.check_tokens({"S1": "site_s1_scc_temporal_v1"}, {"S1": "s1_scc_temporal"})
    with pytest.raises(ValueError):
        catalog.check_tokens({"S1": "site_s1_scc"}, {"S1": "s1_other"})
    with pytest.raises(ValueError):
        catalog.check_tokens({"S1": "site_s1_scc"}, {})


def test_halves_go_to_the_even_digit(spark):
    """1152 is 1.125 KB and 1408 is 1.375 KB; 1.015 lies below the half as a double. Texts equal Python's."""
    sizes = spark.createDataFrame([(1152, "1.12 KB"), (-1152, "-1.12 KB"), (1408, "1.38 KB"), (3 * 2**17, "384.00 KB"), (1179648, "1.12 MB"), (None, None)], "n long, t string")
    assert [r.n for r in sizes.filter(~fn.byte_text(F.col("n")).eqNullSafe(F.col("t"))).collect()] == []
    values = [0.5, 1.5, 2.5, -0.4, 0.125, 0.375, 1.015, 2.675, 0.03125, 1e6, float("nan"), float("inf"), -float("inf")]
    for digits in (0, 2, 4):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fn.fixed(F.col("v"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.v:.{digits}f}" for r in got]
    assert spark.range(1).select(fn.metric_text(F.lit(None).cast("double"))).first()[0] == "N/A"


def test_zero_keeps_its_sign(spark, tmp_path):
    """A balance of -0.0 is '-0 B', as printf has it; the SQL agrees."""
    duckdb = pytest.importorskip("duckdb")
    rows = pd.DataFrame({"c_custkey": range(7), "c_name": "a", "c_mktsegment": "b", "c_acctbal": [-0.0, 0.0, 0.4, -0.4, -1024.0, 1151.5, None]})
    rows.to_parquet(tmp_path / "customer.parquet")
    got = scene_queries.text_helpers(spark, str(tmp_path)).orderBy("c_custkey").collect()
    assert [r["size"] for r in got] == ["-0 B", "0 B", "0 B", "-1 B", "-1.00 KB", "1.12 KB", None]
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet')")
    assert [tuple(r) for r in got] == con.execute(registry.ORACLE_SQL["text_helpers"] + " ORDER BY c_custkey").fetchall()


def test_exact_mean_stays_on_the_threshold(spark):
    """100 times 10.11 and 100 times 19.89 have the mean 15, in any order and any tasks; sums of doubles stray from it."""
    df = spark.range(200, numPartitions=1).select(F.when(F.col("id") < 100, 10.11).otherwise(19.89).alias("v"))
    assert df.agg(F.avg("v")).first()[0] > 15.0
    assert df.repartition(3).agg(fn.exact_mean("v")).first()[0] == 15.0
    assert df.agg(fn.exact_mean("v")).first()[0] == 15.0
    odd = {"tiny": [2.0**-70, 3 * 2.0**-70], "huge": [1e300, 2e300], "none": [None, None], "nan": [1.0, float("nan")], "some": [1.5, None]}
    rows = spark.createDataFrame([(k, v) for k, vs in odd.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(fn.exact_mean("v").alias("m")).collect()}
    assert (got["tiny"], got["huge"], got["none"], got["some"]) == (2.0**-69, 1.5e300, None, 1.5) and math.isnan(got["nan"])


def test_tail_agreement_at_a_cut(spark, tmp_path):
    """Days whose mean is 15, a third of which is the cut of 5, are not above it, however many rows they have."""
    rows = [(i, dt.datetime(2024, 1, 1 + d), p, "view", 10.11 if i < 100 else 19.89, "{}") for p in range(3) for d in range(4) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.cut: r.n_reference for r in helper_queries.tail_agreement(spark, str(tmp_path)).collect()}
    assert got == {5.0: 0, 15.0: 0, 25.0: 0}


def test_boyce_index_has_a_row_where_it_is_undefined(spark):
    """Three windows with rows; presences nowhere, everywhere, or in no row at all leave n and no index."""
    rows = [(0, 0.05), (0, 0.35), (1, 0.35), (1, 0.95), (None, 0.65)]
    df = spark.createDataFrame(rows, "t int, s double")
    index = lambda d: tuple(metrics.boyce(d, "t", "s").collect()[0])
    assert index(df) == (3, pytest.approx(1.0))
    assert index(df.withColumn("t", F.col("t") * 0)) == (3, None)
    assert index(df.withColumn("t", F.col("t") * 0 + 1)) == (3, None)
    assert index(df.limit(0)) == (0, None)
    got = {r.bin: (r.n, r.enrichment) for r in metrics.boyce_windows(df.withColumn("t", F.col("t") * 0), "t", "s").collect()}
    assert math.isnan(got[3][1]) and got[3][0] == 2 and got[6] == (0, None) and got[1] == (0, None)


def test_mosaic_takes_the_first_row_of_a_layer(spark, tmp_path):
    """Both files hold layer 1 of the pixel; the first by name counts, although the second is larger and read first."""
    when = dt.datetime(2020, 1, 1)
    pd.DataFrame({"c_custkey": [1], "c_nationkey": [2]}).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"o_orderkey": [7], "o_custkey": [1], "o_orderdate": pd.Series([when]).astype("datetime64[us]"), "o_orderpriority": ["1-URGENT"], "o_orderstatus": ["F"]}).to_parquet(tmp_path / "orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, flag, n in (("a", "R", 1), ("b", "N", 5000)):
        rows = {"l_orderkey": 7, "l_linenumber": 1, "l_quantity": np.arange(n) * 1.0, "l_tax": np.arange(n) / 7, "l_discount": 0.1, "l_returnflag": flag}
        pd.DataFrame(rows).to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    assert [tuple(r) for r in pixel_queries.mosaic_tiles(spark, str(tmp_path)).collect()] == [(7, 2)]


def test_sizes_blanks_and_zenith(spark):
    df = spark.createDataFrame([(5.0, "5 B"), (1024.0, "1.00 KB"), (1385126953.0, "1.29 GB"), (2.0**50, "1024.00 TB"), (-2048.0, "-2.00 KB")], "n double, t string")
    assert df.filter(fn.byte_text(F.col("n")) != F.col("t")).count() == 0
    blank = {r.t: r.b for r in spark.createDataFrame([("",), (" nan ",), ("None",), ("null",), ("NaT",), (None,)], "t string").select("t", fn.is_blank(F.col("t")).alias("b")).collect()}
    assert blank == {"": True, " nan ": True, "None": True, "null": False, "NaT": False, None: True}
    at = spark.createDataFrame([(dt.datetime(2024, 3, 20, 12), 0.0, 0.0), (dt.datetime(2024, 3, 20, 0), 0.0, 0.0)], "t timestamp, lat double, lon double")
    got = [r[0] for r in at.select(fn.solar_zenith_cosine(F.col("t"), F.col("lat"), F.col("lon"))).collect()]
    assert got[0] == pytest.approx(1.0, abs=0.01) and got[1] == 0.05


def test_chi2_is_shared():
    assert metrics.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-3)
