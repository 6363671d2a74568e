"""Boosted trees grown level by level from histograms, for losses whose first and second derivatives are linear in the response.

Rows that share all their bins have one score, so a model reads the rows once: their number and sum of responses by bins (exact, in multiples of 2^-20) hold all
that any level needs. A level is one aggregate of gradients by (node, feature, bin), added up within tasks before it is shuffled, so it deals nodes x features x bins rows whatever
the data. Gradients are whole multiples of 2^-20: sums are exact, so a level made again after the loss of an executor splits alike. A fitted model is a
Column: scoring is a projection without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize, release
from .models import side_by_side

UNIT = 1 << 20


@dataclass
class Loss:
    """squared, logistic (labels 0 and 1), poisson or tweedie (log link, power between 1 and 2)."""

    name: str = "squared"
    power: float = 1.3

    def start(self, mean: float) -> float:
        if self.name == "squared":
            return mean
        mean = min(max(mean, 1e-9), 1 - 1e-9) if self.name == "logistic" else max(mean, 1e-9)
        return math.log(mean / (1 - mean)) if self.name == "logistic" else math.log(mean)

    def mean(self, score: Column) -> Column:
        if self.name == "squared":
            return score
        return 1 / (1 + F.exp(-score)) if self.name == "logistic" else F.exp(score)

    def slopes(self, y: Column, score: Column) -> tuple[Column, Column]:
        """First and second derivative of the loss by the score, both linear in y: those of a mean response are the means of the rows'."""
        if self.name == "squared":
            return score - y, F.lit(1.0)
        mu = self.mean(score)
        if self.name == "logistic":
            return mu - y, mu * (1 - mu)
        if self.name == "poisson":
            return mu - y, mu
        up, down = F.exp((2 - self.power) * score), y * F.exp((1 - self.power) * score)
        return up - down, (2 - self.power) * up + (self.power - 1) * down

    def deviance(self, y: Column, mu: Column) -> Column:
        """A row's part of the deviance."""
        if self.name == "squared":
            return (y - mu) * (y - mu)
        if self.name == "logistic":
            return -2 * F.when(y > 0, F.log(mu)).otherwise(F.log(1 - mu))
        if self.name == "poisson":
            return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu))
        p = self.power
        return 2 * (F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p)) - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))


@dataclass
class Tree:
    """Splits: node to (feature, last value that goes left or None for nulls alone); leaves: node to value. Node i has the children 2i and 2i + 1."""

    splits: dict[int, tuple[str, float | None]]
    leaves: dict[int, float]

    def value(self, node: int = 1) -> Column:
        if node in self.leaves:
            return F.lit(self.leaves[node])
        return F.when(left(*self.splits[node]), self.value(2 * node)).otherwise(self.value(2 * node + 1))

    def place(self, node: int = 1) -> Column:
        """The node that a row has come to so far."""
        if node not in self.splits:
            return F.lit(node)
        return F.when(left(*self.splits[node]), self.place(2 * node)).otherwise(self.place(2 * node + 1))


def left(feature: str, cut: float | None) -> Column:
    """Nulls and NaN go left of every cut."""
    x = F.col(feature).cast("double")
    missing = x.isNull() | F.isnan(x)
    return missing if cut is None else missing | (x <= cut)


@dataclass
class Boosted:
    loss: Loss
    start: float
    trees: list[Tree]
    gains: dict[str, float]
    n: int

    def score(self) -> Column:
        return sum((t.value() for t in self.trees), F.lit(self.start))

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Adds the expected response."""
        return df.withColumn(name, self.loss.mean(self.score()))


def edges(df: DataFrame, predictors: list[str], bins: int) -> dict[str, list[float]]:
    """Upper ends of at most `bins` bins of each predictor: its values where they are so few, else values at even quantiles. One aggregate."""
    x = {p: F.col(p).cast("double") for p in predictors}
    known = {p: F.when(~F.isnan(c), c) for p, c in x.items()}
    row = df.agg(*(F.percentile_approx(known[p], [i / bins for i in range(1, bins + 1)], 100 * bins).alias(f"q{i}") for i, p in enumerate(predictors))).first()
    return {p: sorted(set(row[f"q{i}"] or [])) for i, p in enumerate(predictors)}


def bin_of(feature: str, ends: list[float]) -> Column:
    """0 for nulls and NaN, else 1 and the number of ends that are smaller, by halving."""
    x = F.col(feature).cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(x <= ends[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(x.isNull() | F.isnan(x), 0).otherwise(search(0, max(0, len(ends) - 1))).cast("int")


def fit(df: DataFrame, y: str, predictors: list[str], loss: Loss | None = None, trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = 64, ridge: float = 1.0,
        least_rows: int = 20, refresh: int = 5) -> Boosted | None:
    """Boosts `trees` trees of a depth; a split needs `least_rows` rows on each side and a gain above 0, ties go to the earlier predictor and smaller cut.

    Predictors may hold nulls and NaN, which share a bin of their own; rows without a finite response are left out. None where no row is left. Scores are
    written every `refresh` trees, so that no plan grows with their number. Responses and gradients must stay below 2^43 over the number of rows in a node.
    """
    loss, spark = loss or Loss(), df.sparkSession
    v = F.col(y).cast("double")
    # one column of bins for each predictor; cuts are on bins, so a tree is grown without the values
    ends = edges(df, predictors, bins)
    names = [f"_x{i}" for i in range(len(predictors))]
    rows = materialize(df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.round(v * UNIT).cast("long").alias("_s"), *(bin_of(p, ends[p]).alias(c) for p, c in zip(predictors, names)))
                       .groupBy(*names).agg(F.count("*").alias("_n"), F.sum("_s").alias("_s")), "boosting")
    first = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum("_s") / UNIT / F.sum("_n")).alias("y")).first()
    if not first.n:
        release(spark, rows)
        return None
    start, fitted, gains, old = loss.start(first.y), [], dict.fromkeys(predictors, 0.0), rows
    base = rows.withColumn("_score", F.lit(start))
    fresh: list[Tree] = []
    for turn in range(trees):
        score = sum((t.value() for t in fresh), F.col("_score"))
        g, h = (F.round(d * F.col("_n") * UNIT).cast("long") for d in loss.slopes(F.col("_s") / UNIT / F.col("_n"), score))
        tree = grow(base, names, g, h, depth, rate, ridge, least_rows, gains, predictors)
        fresh.append(tree)
        fitted.append(Tree({k: (predictors[int(c[2:])], ends[predictors[int(c[2:])]][int(cut) - 1] if cut else None) for k, (c, cut) in tree.splits.items()}, tree.leaves))
        if len(fresh) == refresh and turn + 1 < trees:
            new = materialize(base.withColumn("_score", sum((t.value() for t in fresh), F.col("_score"))), "boosting")
            delete(spark, old._table_path)
            base = old = new
            fresh = []
    release(spark, old)
    return Boosted(loss, start, fitted, gains, first.n)


def grow(rows: DataFrame, names: list[str], g: Column, h: Column, depth: int, rate: float, ridge: float, least_rows: int, gains: dict[str, float], predictors: list[str]) -> Tree:
    """One tree; each level reads the table of bins once, and the driver gets a row for each node, feature and bin."""
    tree, totals = Tree({}, {}), {}
    for level in range(depth):
        live = [n for n in range(1 << level, 2 << level) if level == 0 or n // 2 in tree.splits]
        if not live:
            break
        cells = rows.select(tree.place().alias("_node"), "_n", g.alias("_g"), h.alias("_h"), F.posexplode(F.array(*names)).alias("_f", "_b"))
        got = cells.filter(F.col("_node").isin(live)).groupBy("_node", "_f", "_b").agg(F.sum("_n").alias("n"), F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        cuts: dict[tuple[int, int], list] = {}
        for r in sorted(got, key=lambda r: (r["_node"], r["_f"], r["_b"])):
            cuts.setdefault((r["_node"], r["_f"]), []).append((r["_b"], r.n, r.g / UNIT, r.h / UNIT))
        for node in live:
            best = None
            for f, name in enumerate(names):
                cells_of = cuts.get((node, f), [])
                n, sg, sh = (sum(c[i] for c in cells_of) for i in (1, 2, 3))
                totals[node] = (n, sg, sh)
                ln, lg, lh = 0, 0.0, 0.0
                for cut, cn, cg, ch in cells_of[:-1]:
                    ln, lg, lh = ln + cn, lg + cg, lh + ch
                    if min(ln, n - ln) < least_rows:
                        continue
                    gain = lg**2 / (lh + ridge + 1e-300) + (sg - lg) ** 2 / (sh - lh + ridge + 1e-300) - sg**2 / (sh + ridge + 1e-300)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                        best = (gain, name, cut, f, (ln, lg, lh))
            if best is None:
                continue
            gain, name, cut, f, side = best
            tree.splits[node] = (name, float(cut) if cut else 0.0)
            gains[predictors[f]] += gain
            totals[2 * node], totals[2 * node + 1] = side, tuple(a - b for a, b in zip(totals[node], side))
    for node in [1] if not tree.splits else [c for n in tree.splits for c in (2 * n, 2 * n + 1) if c not in tree.splits]:
        n, sg, sh = totals.get(node, (0, 0.0, 0.0))
        tree.leaves[node] = -rate * sg / (sh + ridge + 1e-300)
    return tree


def hurdle(train: DataFrame, test: DataFrame, y: str, predictors: list[str], positive: Loss | None = None, name: str = "predicted", **options) -> DataFrame:
    """The chance that y is above zero times its expected value where it is; adds `<name>_chance` and `name`, both null if no row trains them."""
    v = F.col(y).cast("double")
    present = fit(train.withColumn("_present", F.when(v > 0, 1.0).when(v <= 0, 0.0)), "_present", predictors, Loss("logistic"), **options)
    amount = fit(train.filter((v > 0) & ~F.isnan(v)), y, predictors, positive or Loss("tweedie", 1.9), **options)
    chance = present.loss.mean(present.score()) if present else F.lit(None).cast("double")
    value = amount.loss.mean(amount.score()) if amount else F.lit(0.0)
    return test.withColumns({f"{name}_chance": chance, name: chance * F.greatest(value, F.lit(0.0))})


def held_out(df: DataFrame, y: str, predictors: list[str], fold: str, fits: dict[str, Loss], **options) -> DataFrame:
    """Every row scored by each model (and by `hurdle`) fitted without the row's fold: the columns of df, model, predicted.

    Folds are few; their fits run side by side.
    """
    def one(f, model: str) -> DataFrame:
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f).withColumn("model", F.lit(model))
        if model == "hurdle":
            return hurdle(train, test, y, predictors, **options).drop("predicted_chance")
        got = fit(train, y, predictors, fits[model], **options)
        return test.withColumn("predicted", got.loss.mean(got.score()) if got else F.lit(None).cast("double"))

    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    return reduce(DataFrame.unionByName, side_by_side(one, [(f, model) for f in folds for model in (*fits, "hurdle")]))
