"""Boosted trees from histograms: splits against brute force, planted interactions, losses and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.operators import boosting, models
from shoalwork.operators.boosting import Loss


def made(spark, n=4000, seed=3):
    r = np.random.default_rng(seed)
    a, b, c = r.uniform(-1, 1, n), r.uniform(-1, 1, n), r.integers(0, 5, n)
    mu = np.exp(0.3 + 1.2 * np.sign(a * b) + 0.1 * c)
    y = np.array([r.gamma(2.0, 0.5, k).sum() for k in r.poisson(mu)])
    return spark.createDataFrame([(i, float(a[i]), float(b[i]) if i % 17 else None, int(c[i]), float(y[i])) for i in range(n)], "id int, a double, b double, c int, y double")


def test_the_first_split_equals_brute_force(spark):
    df = made(spark, 600).withColumn("a", F.round("a", 1)).withColumn("b", F.round("b", 1))
    got = boosting.fit(df, "y", ["a", "b", "c"], trees=1, depth=1, rate=1.0, ridge=0.0, least_rows=10)
    p, best = df.toPandas(), None
    mean = p.y.mean()
    for x in ("a", "b", "c"):
        v = p[x].fillna(-np.inf)
        for cut in sorted(v.unique())[:-1]:
            lo, hi = p.y[v <= cut], p.y[v > cut]
            if min(len(lo), len(hi)) >= 10:
                gain = len(lo) * (lo.mean() - mean) ** 2 + len(hi) * (hi.mean() - mean) ** 2
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, x, cut, lo.mean(), hi.mean())
    assert got.trees[0].splits[1] == (best[1], best[2] if np.isfinite(best[2]) else None)
    assert got.start + got.trees[0].leaves[2] == pytest.approx(best[3], abs=1e-5) and got.start + got.trees[0].leaves[3] == pytest.approx(best[4], abs=1e-5)
    assert got.gains[best[1]] == pytest.approx(best[0], rel=1e-5)


def test_tweedie_trees_beat_the_linear_model_on_an_interaction(spark):
    df = made(spark)
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    loss = Loss("tweedie", 1.3)
    trees = boosting.fit(train, "y", ["a", "b", "c"], loss, trees=12, depth=3, rate=0.3)
    flat = models.tweedie(train.fillna(0.0), ["a", "b", "c"], "y", 1.3).transform(test.fillna(0.0)).withColumnRenamed("prediction", "predicted")

    def deviance(rows):
        return rows.agg(F.avg(loss.deviance(F.col("y"), F.col("predicted")))).first()[0]

    assert deviance(trees.predict(test)) < 0.8 * deviance(flat)
    assert trees.gains["a"] > trees.gains["c"] and trees.predict(test).filter("predicted <= 0 OR predicted IS NULL").isEmpty()
    plan = trees.predict(test)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_hurdle_multiplies_chance_and_amount(spark):
    df = made(spark, 1500)
    got = boosting.hurdle(df, df, "y", ["a", "b", "c"], trees=6, depth=2, rate=0.4)
    row = got.agg(F.avg("predicted"), F.avg("y"), F.avg("predicted_chance"), F.avg((F.col("y") > 0).cast("double")), F.min("predicted_chance"), F.max("predicted_chance")).first()
    assert row[0] == pytest.approx(row[1], rel=0.15) and row[2] == pytest.approx(row[3], abs=0.03) and 0 < row[4] < row[5] < 1


def test_fits_are_alike_however_rows_are_dealt(spark):
    df = made(spark, 1000)
    one, two = (boosting.fit(d, "y", ["a", "c"], Loss("poisson"), trees=3, depth=2) for d in (df.coalesce(1), df.orderBy(F.desc("y")).repartition(7)))
    assert one.trees == two.trees


def test_odd_input(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, float("nan")), (3.0, None, None), (4.0, None, 5.0)], "a double, b double, y double")
    assert boosting.fit(df.limit(0), "y", ["a"]) is None
    got = boosting.fit(df, "y", ["a", "b"], trees=2, depth=2, least_rows=1, rate=1.0, ridge=0.0)
    assert got.n == 2 and {r.a: r.predicted for r in got.predict(df).collect()} == {1.0: pytest.approx(1.0), 2.0: pytest.approx(5.0), 3.0: pytest.approx(5.0), 4.0: pytest.approx(5.0)}
    assert boosting.fit(df.withColumn("y", F.lit(2.0)), "y", ["a"], trees=1, least_rows=1).trees[0].leaves == {1: 0.0}
    nothing = boosting.hurdle(df.limit(0), df, "y", ["a"])
    assert nothing.filter("predicted IS NULL").count() == 4


def test_trees_grow_from_rows_added_up_by_bins(spark, monkeypatch):
    """20,000 rows of 30 different predictors: levels read their 30 sums, and splits are those of single rows."""
    seen, real = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    df = spark.range(20000).select((F.col("id") % 6).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), F.when(F.col("id") % 7 > 2, F.pmod(F.hash("id"), F.lit(1000)) / 100 + F.col("id") % 6).otherwise(0.0).alias("y"))
    for loss in (Loss("tweedie"), Loss("poisson"), Loss("squared")):
        got = boosting.fit(df, "y", ["a", "b"], loss, trees=2, depth=2)
        p, score = df.toPandas(), got.start
        for tree in got.trees:  # leaves by Newton's step over single rows
            node = np.ones(len(p), int)
            for k, (x, cut) in sorted(tree.splits.items()):
                left = p[x].isna() if cut is None else p[x].isna() | (p[x] <= cut)
                node = np.where(node == k, np.where(left, 2 * k, 2 * k + 1), node)
            up, down = np.exp(0.7 * score), p.y * np.exp(-0.3 * score)
            g, h = {"tweedie": (up - down, 0.7 * up + 0.3 * down), "poisson": (np.exp(score) - p.y, np.exp(score) + 0 * p.y), "squared": (score - p.y, 1 + 0 * p.y)}[loss.name]
            for k, value in tree.leaves.items():
                assert value == pytest.approx(-0.1 * g[node == k].sum() / (h[node == k].sum() + 1), abs=1e-5)
            score = score + np.array([tree.leaves[k] for k in node])
    assert max(seen) <= 30
