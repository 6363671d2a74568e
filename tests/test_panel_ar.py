"""The panel regression from sums of products against the one that fits all rows at once."""

import math

import numpy as np
import pandas as pd
import pytest

from shoalwork.operators import panel_ar
from shoalwork.operators.panel_ar import two_sided

from .panel_fit import PanelFit
from .test_statistics import month, panel_rows


def frame(spark, rows):
    return spark.createDataFrame([(r.region, month(r.mi - 24000), float(r.y), float(r.x), float(r.z)) for r in rows.itertuples()], "region string, month date, y double, x double, z double").repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Regions of unlike length with gaps, far from zero, and one whose lags are never there."""
    r = np.random.default_rng(8)
    rows = panel_rows(regions=7, months=50)
    rows["z"] = r.normal(size=len(rows)) + 40
    rows["y"] += 300 + 0.3 * (rows.z - 40)
    keep = r.random(len(rows)) > 0.12
    return rows[keep & ~((rows.region == "r3") & (rows.mi < 24030))].reset_index(drop=True)


def close(a, b):
    return a == pytest.approx(b, rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("order,most,model", [(1, None, {}), (2, None, {}), (1, 3, {}), (2, 2, {"harmonics": 1, "trend": True})])
def test_coefficients(spark, rows, order, most, model):
    want = PanelFit(rows, ["x", "z"], order, most, **model)
    got = {r.term: r for r in panel_ar.panel_ar(frame(spark, rows), "region", "y", ["x", "z"], order, most_lags=most, **model).collect()}
    errors = np.sqrt(np.diag(want.cov))
    assert set(got) == {n for n, _ in want.names()} | {f"rho{h}" for h in range(1, order + 1)}
    for (name, kind), b, se in zip(want.names(), want.beta, errors):
        r = got[name]
        assert r.kind == kind and close(r.estimate, b) and close(r.std_error, se) and close(r.t, b / se) and close(r.p, two_sided(b / se)), name
    for h, v in enumerate(want.rho, 1):
        assert close(got[f"rho{h}"].estimate, v)
    assert all(r.n == want.n and r.n_clusters == want.clusters and close(r.aicc, want.criterion) for r in got.values())


def test_keys_are_fits_of_their_own(spark, rows):
    both = pd.concat([rows.assign(panel="a"), rows[rows.region < "r4"].assign(panel="b"), rows.head(3).assign(panel="few")])
    df = spark.createDataFrame([(r.panel, r.region, month(r.mi - 24000), float(r.y), float(r.x)) for r in both.itertuples()], "panel string, region string, month date, y double, x double")
    got = {(r.panel, r.term): r.estimate for r in panel_ar.panel_ar(df, "region", "y", ["x"], 1, ["panel"]).collect()}
    for name, part in (("a", rows), ("b", rows[rows.region < "r4"])):
        want = PanelFit(part, ["x"], 1)
        assert all(close(got[name, term], b) for (term, _), b in zip(want.names(), want.beta)) and close(got[name, "rho1"], want.rho[0])
    assert {k for k, _ in got} == {"a", "b"}


def test_residuals(spark, rows):
    want = PanelFit(rows, ["x"], 1)
    e = {(want.regions[r], m): v for r, m, v in zip(want.region, want.mi, want.residuals()) if math.isfinite(v)}
    got = {(r.region, 12 * r.month.year + r.month.month - 1): r for r in panel_ar.panel_residuals(frame(spark, rows), "region", "y", ["x"]).collect()}
    assert set(got) == set(e) and all(close(got[k].residual, v) and close(got[k].fitted + got[k].residual, got[k].y) for k, v in e.items())


def test_orders(spark, rows):
    got = {r.order: r for r in panel_ar.order_table(frame(spark, rows), "region", "y", ["x"], 3).collect()}
    for o in range(4):
        want = PanelFit(rows, ["x"], o, 3)
        assert got[o].n == want.n and close(got[o].aicc, want.criterion)
    assert [o for o, r in got.items() if r.chosen] == [min(got, key=lambda o: got[o].aicc)]
    few = panel_ar.order_table(frame(spark, rows.head(6)), "region", "y", ["x"], 2).collect()
    assert [(r.order, r.aicc, r.chosen) for r in sorted(few)] == [(o, None, False) for o in range(3)]
    assert panel_ar.order_table(frame(spark, rows).limit(0), "region", "y", ["x"], 2).collect() == []


def test_forecasts_at_every_origin(spark, rows):
    got = {(12 * r.target.year + r.target.month - 1, r.region): r for r in panel_ar.one_month_forecasts(frame(spark, rows), "region", "y", ["x"], least_months=25).collect()}
    months, n = sorted(rows.mi.unique()), 0
    known = {(r.region, r.mi): r.y for r in rows.itertuples()}
    for k, origin in enumerate(months):
        past, ahead = rows[rows.mi <= origin], rows[rows.mi == origin + 1]
        if k + 1 < 25 or origin + 1 not in months or len(past) < 30:
            continue
        plain, full = PanelFit(past, [], 1), PanelFit(past, ["x"], 1)
        if not (plain.usable and full.usable):
            continue
        (a, _), (b, used) = plain.forecast(ahead), full.forecast(ahead)
        sampled = {full.regions[i] for i in full.region[full.sample]}
        for i, r in enumerate(ahead.itertuples()):
            own = got.pop((r.mi, r.region))
            n += 1
            if r.region in sampled:
                assert close(own.plain, a[i]) and close(own.full, b[i]) and own.n_errors == used[i]
            else:
                assert own.plain is None and own.full is None
            assert own.observed == r.y and own.persistence == known.get((r.region, origin)) and own.seasonal == known.get((r.region, origin - 11))
    assert not got and n > 60


def test_each_region_left_out(spark, rows):
    got = {(r.left_out, r.term): r for r in panel_ar.without_each_region(frame(spark, rows), "region", "y", ["x", "z"]).collect()}
    assert {k for k, _ in got} == set(rows.region)
    for name in set(rows.region):
        want = PanelFit(rows[rows.region != name], ["x", "z"], 1)
        for (term, kind), b, se in zip(want.names(), want.beta, np.sqrt(np.diag(want.cov))):
            if kind == "driver":
                r = got[name, term]
                assert close(r.estimate, b) and close(r.std_error, se) and r.n == want.n and r.n_clusters == want.clusters


def test_no_grouped_python(spark, rows, capsys):
    df = frame(spark, rows)
    for got in (panel_ar.panel_ar(df, "region", "y", ["x"]), panel_ar.one_month_forecasts(df, "region", "y", ["x"]), panel_ar.panel_residuals(df, "region", "y", ["x"])):
        got.explain()
        plan = capsys.readouterr().out
        assert "FlatMapGroups" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nulls_and_repeats(spark, rows):
    df = frame(spark, rows)
    odd = df.unionByName(df.limit(20)).unionByName(spark.createDataFrame([(None, None, 1.0, 2.0, 3.0), ("r1", month(60), None, 1.0, 1.0), ("r1", month(61), float("nan"), 1.0, 1.0)], df.schema))
    a, b = ({r.term: r.estimate for r in panel_ar.panel_ar(d, "region", "y", ["x"]).collect()} for d in (df, odd))
    assert a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
