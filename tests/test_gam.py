"""Penalised additive models: planted smooths, group means, whitening, levels and odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.operators import gam


def made(spark, n=3000, seed=5):
    r = np.random.default_rng(seed)
    x, z, g = r.uniform(0, 1, n), r.uniform(0, 1, n), r.integers(0, 30, n)
    eta = 0.4 + np.sin(2 * np.pi * x) + 0.8 * z
    level = np.sin(np.arange(30) * 1.7)
    mu = 1 / (1 + np.exp(-eta))
    lam = np.exp(eta / 2)
    counts = r.poisson(lam)
    tw = np.array([r.gamma(2.0, 0.5, c).sum() for c in counts])
    cols = [x, z, x**2, eta + 0.3 * r.normal(size=n), eta + level[g] + 0.3 * r.normal(size=n), r.beta(mu * 20, (1 - mu) * 20), tw]
    return spark.createDataFrame([(int(a), *map(float, v)) for a, v in zip(g, zip(*cols))], "g int, x double, z double, x2 double, y double, yg double, b double, t double"), level


def test_a_planted_smooth_comes_back(spark):
    df, level = made(spark)
    fit = gam.fit(df, "y", {"x": 15}, ["z"])
    got = fit.partial(spark, "x", 41).toPandas()
    assert np.abs(got.effect - np.sin(2 * np.pi * got.x)).max() < 0.12
    terms = {t.term: t for t in fit.terms.collect()}
    assert 4 < terms["x"].edf < 12 and terms["z"].edf == pytest.approx(1, abs=1e-6) and fit.beta[1] == pytest.approx(0.8, abs=0.06)
    assert terms["x"].concurvity < 0.1 and fit.stats["deviance_explained"] > 0.8 and fit.stats["scale"] == pytest.approx(0.09, rel=0.1)
    twin = {t.term: t for t in gam.fit(df, "y", {"x": 8, "x2": 8}, ["z"]).terms.collect()}
    assert twin["x"].concurvity > 0.9


def test_a_straight_line_takes_one_degree_and_selection_drops_noise(spark):
    df, _ = made(spark)
    line = df.withColumn("w", 2 * F.col("z") + 0.1 * F.randn(3))
    fit = gam.fit(line, "w", {"z": 10, "x": 10}, select=True)
    terms = {t.term: t for t in fit.terms.collect()}
    assert terms["z"].edf < 2.5 and terms["x"].edf < 2.5


def test_levels_shrink_to_the_planted_ones(spark):
    df, level = made(spark)
    fit = gam.fit(df, "yg", {"x": 12}, ["z"], group="g")
    got = fit.levels.orderBy("g").toPandas()
    assert np.abs(got.effect - (level - level.mean())).max() < 0.2 and fit.stats["scale"] == pytest.approx(0.09, rel=0.1)
    edf = {t.term: t.edf for t in fit.terms.collect()}["g"]
    assert 25 < edf < 30
    error = fit.predict(df).agg(F.avg(F.pow(F.col("predicted") - F.col("yg"), 2))).first()[0]
    assert error < 0.1


def test_levels_by_elimination_equal_the_whole_system(spark):
    df, _ = made(spark, 400)
    fit = gam.fit(df, "yg", {}, ["z"], group="g")
    lam = {t.term: t.penalty for t in fit.terms.collect()}["g"]
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.z, np.eye(30)[pdf.g]])
    want = np.linalg.solve(x.T @ x + lam * np.diag([0, 0] + [1] * 30), x.T @ pdf.yg)
    assert fit.beta == pytest.approx(want[:2], abs=1e-6)
    got = fit.levels.orderBy("g").toPandas()
    assert got.effect.to_numpy() == pytest.approx(want[2:][got.g], abs=1e-6)


def test_beta_and_tweedie_responses(spark):
    df, _ = made(spark)
    fit = gam.fit(df, "b", {"x": 12}, ["z"], gam.Family("beta"))
    assert fit.stats["precision"] == pytest.approx(20, rel=0.12) and fit.beta[1] == pytest.approx(0.8, abs=0.1)
    got = fit.partial(spark, "x", 41).toPandas()
    assert np.abs(got.effect - np.sin(2 * np.pi * got.x)).max() < 0.2
    tw = gam.best_power(df, "t", {"x": 12}, [1.2, 1.34, 1.6], linear=["z"])
    assert tw.stats["power"] == 1.34 and tw.beta[1] == pytest.approx(0.4, abs=0.15)  # gammas of shape 2: power (2 + 2) / (2 + 1)
    assert tw.predict(df).filter("predicted <= 0 OR predicted IS NULL").isEmpty()


def test_a_factor_gives_group_means_under_every_power(spark):
    df, _ = made(spark)
    df = df.withColumn("f", (F.col("x") > 0.5).cast("double"))
    means = {r.f: r.m for r in df.groupBy("f").agg(F.avg("t").alias("m")).collect()}
    for family in (gam.Family("poisson"), gam.Family("tweedie", 1.3), gam.Family("tweedie", 1.7)):
        beta = gam.fit(df, "t", {}, ["f"], family).beta
        assert np.exp(beta[0]) == pytest.approx(means[0.0], rel=1e-6) and np.exp(beta.sum()) == pytest.approx(means[1.0], rel=1e-6)


def test_whitening_equals_generalised_least_squares(spark):
    r = np.random.default_rng(2)
    rows, rho = [], 0.6
    for s in range(4):
        e = 0.0
        for m in range(60):
            e = rho * e + r.normal()
            if m != 30:
                rows.append((s, m, float(r.normal()), e))
    rows = [(s, m, x, 1 + 2 * x + e) for s, m, x, e in rows]
    df = spark.createDataFrame(rows, "s int, m int, x double, y double")
    got = gam.fit(df, "y", {}, ["x"], series=["s"], month="m", rho=rho)
    keep = np.array(rows)
    x, y, out = np.column_stack([np.ones(len(keep)), keep[:, 2]]), keep[:, 3], []
    for i in range(len(keep)):
        run = i and keep[i - 1, 0] == keep[i, 0] and keep[i - 1, 1] == keep[i, 1] - 1
        out.append((np.append(x[i], y[i]) - rho * np.append(x[i - 1], y[i - 1])) / math.sqrt(1 - rho**2) if run else np.append(x[i], y[i]))
    out = np.array(out)
    assert got.beta == pytest.approx(np.linalg.lstsq(out[:, :2], out[:, 2], rcond=None)[0], abs=1e-8)


def test_tweedie_density_adds_up_to_one(spark):
    y = np.linspace(1e-4, 40, 40001)
    for power, scale in ((1.2, 0.5), (1.5, 1.0), (1.8, 0.7)):
        mass = np.exp(gam.tweedie_log_density(np.zeros(1), np.array([2.0]), scale, power))[0]
        dense = np.exp(gam.tweedie_log_density(y, np.full_like(y, 2.0), scale, power))
        assert mass + float(((dense[1:] + dense[:-1]) / 2 * np.diff(y)).sum()) == pytest.approx(1, abs=6e-3)


def test_odd_input(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (2.0, 1.0, 1.0), (float("nan"), 2.0, 1.0), (4.0, 3.0, 1.0), (4.0, 3.0, 1.0)], "x double, y double, c double")
    assert gam.fit(df.limit(0), "y", {"x": 5}) is None
    assert gam.fit(df.withColumn("y", F.lit(0.0)), "y", {"x": 5}, family=gam.Family("tweedie")) is None
    flat = gam.fit(df, "y", {"c": 5})
    assert flat.terms.isEmpty() and flat.stats["n"] == 4 and flat.beta[0] == pytest.approx(9 / 4)
    got = gam.fit(df, "y", {"x": 6})
    assert got.stats["n"] == 4 and got.predict(df).filter("predicted IS NULL").count() == 1


def test_levels_are_added_up_within_tasks(spark, monkeypatch):
    """20,000 rows dealt at random over 500 levels, one of them half of all: a round reads them once and puts out about a row for each level."""
    seen, real = [], gam.materialize
    monkeypatch.setattr(gam, "materialize", lambda df, name: (out := real(df, name), name == "gam-parts" and seen.append(out.count()))[0])
    df = spark.range(20000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.pmod(F.hash("id"), F.lit(500)))).alias("g"), (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 1000).alias("x"))
    df = df.withColumn("y", F.col("x") * F.col("x") + F.col("g") % 3).repartition(4, "x")
    got = gam.fit(df, "y", {"x": 6}, [], gam.Family("gaussian"), group="g", rounds=2)
    assert seen and max(seen) < 800 and got.levels.count() == df.select("g").distinct().count()
    effect = {r.g: r.effect for r in got.levels.collect()}
    assert effect[1] - effect[0] == pytest.approx(1.0, abs=0.05) and effect[2] - effect[0] == pytest.approx(2.0, abs=0.1)
