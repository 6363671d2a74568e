"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root to a node becomes a
conjunctive rule, a logistic regression under a lasso penalty weighs the rules, and those that keep a
weight are compiled into one Spark column expression. Scoring is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import doc_texts

SAMPLE_ROWS = 8000  # labelled rows that a classifier is fitted on, at most


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text (not null); shares are 0 where there is nothing to count."""
    n = F.length(text).cast("double")
    words = F.filter(F.split(text, "[ \n\t\r]+"), lambda w: w != "")
    parts = F.filter(F.split(text, "[.\n]+ *"), lambda p: p != "")

    def share(count: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(count.cast("double"), of.cast("double")), F.lit(0.0))

    def plain(char: str) -> Column:
        return n - F.length(F.replace(text, F.lit(char), F.lit("")))

    return {
        "chars": n,
        "words": F.size(words).cast("double"),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_parts": share(F.size(F.array_distinct(parts)), F.size(parts)),
        "word_length": share(n, F.size(words)),
        "upper": share(F.regexp_count(text, F.lit("\\p{Lu}")), n),
        "symbols": share(F.regexp_count(text, F.lit("[^\\p{L}\\p{M}\\p{N}\\s.,|!]")), n),
        "bars": share(plain("|"), n),
        "exclamations": share(plain("!"), n),
        "digits": share(F.regexp_count(text, F.lit("[0-9]")), n),
    }


NAMES = ["chars", "words", "distinct_words", "distinct_parts", "word_length", "upper", "symbols", "bars", "exclamations", "digits"]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most this) and (statistic, more than this), with a weight."""

    tests: tuple[tuple[str, bool, float], ...]  # statistic, whether at most, threshold
    weight: float = 0.0


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]


def grow(x: np.ndarray, target: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: tuple, out: list) -> np.ndarray:
    """A regression tree by Newton steps; adds every node's path to out and returns each row's value."""
    value = np.full(len(x), target.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return value
    best = (1e-6, None, None)
    base = target.sum() ** 2 / (hess.sum() + 1.0)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = np.searchsorted(edges, x[:, j], "left")
        g, h, n = (np.cumsum(np.bincount(bins, w, len(edges) + 1))[:-1] for w in (target, hess, np.ones(len(x))))
        gain = g**2 / (h + 1) + (target.sum() - g) ** 2 / (hess.sum() - h + 1) - base
        gain[(n < least) | (len(x) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, float(edges[k]))
    if best[1] is None:
        return value
    _, j, cut = best
    left = x[:, j] <= cut
    for side, at_most in ((left, True), (~left, False)):
        longer = (*path, (j, at_most, cut))
        out.append(longer)
        value[side] = grow(x[side], target[side], hess[side], cuts, depth - 1, least, longer, out)
    return value


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal steps."""
    n, k = r.shape
    scale = np.maximum(r.std(0), 0.05)
    a = np.hstack([np.ones((n, 1)), (r - r.mean(0)) / scale])
    step = 4.0 / max(np.linalg.norm(a.T @ a / n, 2), 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    weights = w[1:] / scale
    return float(w[0] - weights @ r.mean(0)), weights


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, penalty: float = 0.0008) -> Model:
    """Fits the ensemble; with one class or none, a constant model of the mean label (a half without rows)."""
    if len(y) == 0 or y.min() == y.max():
        mean = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        return Model(float(np.log(mean / (1 - mean))), ())
    least = max(3, len(y) // 500)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        mids = (values[1:] + values[:-1]) / 2
        cuts.append(mids if len(mids) <= 128 else mids[np.linspace(0, len(mids) - 1, 128).astype(int)])
    f, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        f = f + 0.3 * grow(x, y - p, p * (1 - p), cuts, depth, least, (), paths)
    paths = list(dict.fromkeys(paths))
    held = np.stack([np.logical_and.reduce([(x[:, j] <= c) == below for j, below, c in path]) for path in paths], 1).astype(float)
    bias, weights = lasso(held, y, penalty)
    kept = tuple(Rule(tuple((names[j], below, c) for j, below, c in path), float(w)) for path, w in zip(paths, weights) if w)
    return Model(bias, kept)


def compile_rules(model: Model) -> Column:
    """The model as a column expression over columns named after the statistics."""
    total = F.lit(model.bias)
    for rule in model.rules:
        held = None
        for name, below, cut in rule.tests:
            test = F.col(name) <= F.lit(cut) if below else F.col(name) > F.lit(cut)
            held = test if held is None else held & test
        total = total + F.when(held, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most sample_rows labelled documents outside the held-out fold, taken in hash order.

    Rows without a doc_id or with a quality other than 0 or 1 are passed over; of labels that
    contradict each other the larger holds. Only statistics and labels reach the driver.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("double").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)")
        .filter(fold(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = doc_texts(docs).join(F.broadcast(known), "doc_id").select("quality", *(c.alias(n) for n, c in statistics(F.col("text")).items())).limit(4 * sample_rows)
    got = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 1 + len(NAMES))
    return fit_rules(got[np.lexsort(got.T)][:, 1:], got[np.lexsort(got.T)][:, 0], NAMES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs, and score (0 to 1; higher: label 1 likelier), which replaces a column of that name.

    Null texts count as empty; empty texts are scored like any other.
    """
    stats, given = statistics(F.coalesce("text", F.lit(""))), [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("_row"), *(c.alias(n) for n, c in stats.items()))
    return rows.select("_row", compile_rules(model).alias("_score")).select("_row.*", F.col("_score").alias("score"))
