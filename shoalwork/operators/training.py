"""Training and validation tables for classifiers: reference points, corrections, manifests, diagnostics by arm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import block_id, point_of_json
from ..plans.storage import delete
from . import models
from .rules import label_code


def training_rows(df: DataFrame, codes: dict[str, int], label: str = "class", geo: str = ".geo", wanted: Column | None = None) -> DataFrame:
    """Rows with a class and a place: `label_code`, lon and lat are added; rows outside `wanted` are left out."""
    at = point_of_json(F.col(f"`{geo}`"))
    rows = df.withColumns({"label_code": label_code(F.col(label).cast("string"), codes), "lon": at[0], "lat": at[1]})
    rows = rows.filter(F.col("label_code").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return rows if wanted is None else rows.filter(wanted)


def reference_points(df: DataFrame, codes: dict[str, int], rule: Column, label: str = "class", geo: str = ".geo", degrees: float = 0.1) -> DataFrame:
    """Training rows with the class that a rule gives them and the block they lie in, for validation by blocks."""
    rows = training_rows(df, codes, label, geo)
    return rows.withColumns({"rule_code": rule, "block": block_id(F.col("lon"), F.col("lat"), degrees)})


def correction_rows(points: DataFrame, samples: DataFrame, scene: str, place: list[str], codes: dict[str, int], label: str, source: str = "manual") -> DataFrame:
    """Hand-labelled points of several scenes (a ';'-joined list) as training rows: one for each scene that has predictors there.

    samples has the scene, the place and predictors; points without a class or predictors are left out.
    """
    each = points.withColumn(scene, F.explode(F.split(scene, ";"))).withColumn(scene, F.trim(scene)).filter(F.col(scene) != "")
    each = each.withColumn("label_code", label_code(F.col(label).cast("string"), codes)).filter("label_code is not null")
    return each.join(samples, [scene, *place]).withColumn("source", F.lit(source))


def baked_features(df: DataFrame, baked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with each column filled from a table of values sampled beforehand, where it has none of its own."""
    own = [c for c in columns if c in df.columns]
    joined = df.join(baked.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns)).dropDuplicates(keys), keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_b_{c}") if c in own else F.col(f"_b_{c}") for c in columns}).drop(*(f"_b_{c}" for c in columns))


def first_tile(points: DataFrame, tiles: DataFrame, place: list[str], order: str, columns: list[str]) -> DataFrame:
    """Values at points from the first tile (by `order`) that holds them; nulls where none does."""
    best = tiles.groupBy(*place).agg(F.min_by(F.struct(*columns), order).alias("_v"))
    return points.join(best, place, "left").select(*points.columns, *(F.col(f"_v.{c}").alias(c) for c in columns))


def manifest_checks(df: DataFrame, key: str, required: list[str], expected: DataFrame | None = None) -> DataFrame:
    """One row: rows, distinct ids, null ids, rows that lack a required value, and (of an expected table) ids missing and ids too many."""
    lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required), F.lit(False))
    out = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_ids"), F.count_if(F.col(key).isNull()).alias("n_null_ids"), F.count_if(lacking).alias("n_incomplete"))
    if expected is None:
        return out
    ids, wanted = df.select(key).distinct(), expected.select(key).distinct()
    missing = wanted.join(ids, key, "left_anti").agg(F.count("*").alias("n_missing"))
    extra = ids.filter(F.col(key).isNotNull()).join(wanted, key, "left_anti").agg(F.count("*").alias("n_extra"))
    return out.join(F.broadcast(missing)).join(F.broadcast(extra))  # one row each


def set_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n and one number for a set of rows, the same in any order: sums of the rows' hashes, so no task gathers them."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def fold_summary(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric over folds."""
    return scores.groupBy(*keys).agg(F.count("*").alias("folds"), *(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def random_split(df: DataFrame, keys: list[str], train: float = 0.7, seed: int = 42) -> DataFrame:
    """Rows with `part`: train for a share of them, else test, by a hash of the keys, so the same on any cluster."""
    spot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn("part", F.when(spot < train, "train").otherwise("test"))


def scope_ablation(df: DataFrame, predictors: list[str], model: str, arms: dict[str, Column], test: Column, fold: str = "fold", seed: int = 42) -> DataFrame:
    """Scores of one model trained on different parts of the rows, always tested on the same rows of the same folds: arm, fold and the metrics."""
    estimator, names = models.candidates(seed)[model], list(arms)
    within = {f"_arm{i}": arms[arm] for i, arm in enumerate(names)}
    counted = models.alike(df.withColumns(within), predictors, fold, *within) if models.by_counts(estimator) else None
    known = df if counted is None else counted
    complete = counted is not None and counted.filter(models.lacking(predictors)).isEmpty()
    folds = sorted(r[0] for r in known.select(fold).distinct().collect())

    def held_out(arm: str, f) -> DataFrame:
        own = None if counted is None else counted.filter((F.col(fold) != f) & F.col(f"_arm{names.index(arm)}"))
        fit = models.fitted(estimator, predictors, df.filter((F.col(fold) != f) & arms[arm]), own, complete)
        return fit.transform(df.filter((F.col(fold) == f) & test)).select("label", fold, F.col("prediction").cast("int").alias("predicted"), F.lit(arm).alias("arm"))

    parts = models.side_by_side(held_out, [(arm, f) for arm in arms for f in folds])
    classes = sorted(int(r[0]) for r in known.select("label").distinct().collect())
    if counted is not None:
        delete(df.sparkSession, counted._table_path)
    return models.metric_suite(reduce(DataFrame.unionByName, parts), ["arm", fold], "label", "predicted", classes)


def arm_differences(scores: DataFrame, fold: str, arm: str, base: str, metric: str) -> DataFrame:
    """Paired differences to the base arm over folds: arm, folds, mean, std and wins."""
    b = scores.filter(F.col(arm) == base).select(fold, F.col(metric).alias("_base"))
    d = scores.filter(F.col(arm) != base).join(b, fold).withColumn("_d", F.col(metric) - F.col("_base"))
    return d.groupBy(arm).agg(F.count("_d").alias("folds"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("std"), F.count_if(F.col("_d") > 0).alias("wins"))


def learning_curve(df: DataFrame, predictors: list[str], model: str, shares: list[float], keys: list[str], test: Column, seed: int = 42) -> DataFrame:
    """Scores on fixed test rows of a model trained on growing shares of the rest (nested, by hash): share and the metrics."""
    parts = []
    for share in shares:
        few = random_split(df.filter(~test), keys, share, seed).filter("part = 'train'").drop("part")
        fit = models.pipeline(models.candidates(seed)[model], predictors).fit(models.balanced(few))
        parts.append(fit.transform(df.filter(test)).select("label", F.col("prediction").cast("int").alias("predicted"), F.lit(share).alias("share")))
    classes = sorted(int(r[0]) for r in df.select("label").distinct().collect())
    return models.metric_suite(reduce(DataFrame.unionByName, parts), ["share"], "label", "predicted", classes)


def paired_features(df: DataFrame, base: list[str], more: list[str], names: list[str], fold: str = "fold") -> DataFrame:
    """Scores by model and fold with the base predictors and with more, each fitted once on the same rows: arm ('base', 'more') besides."""
    out = []
    for arm, predictors in (("base", base), ("more", [*base, *more])):
        rows = models.cross_validate(df, predictors, {n: models.candidates()[n] for n in names}, fold)[1]
        out.append(rows.withColumn("arm", F.lit(arm)))
    return out[0].unionByName(out[1])


def point_difficulty(predictions: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """Of every point over models and folds: how often it was tried and wrong, and the class it was taken for most (least class of several)."""
    wrong = F.col(truth) != F.col(predicted)
    per = predictions.filter(wrong).groupBy(key, predicted).agg(F.count("*").alias("_n"))
    mistaken = per.groupBy(key).agg(F.min_by(predicted, F.struct(-F.col("_n"), F.col(predicted))).alias("taken_for"))
    return predictions.groupBy(key).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong")).join(mistaken, key, "left")


def worst_points(difficulty: DataFrame, key: str, k: int) -> DataFrame:
    return difficulty.orderBy(F.desc(F.col("n_wrong") / F.col("n")), F.desc("n"), key).limit(k)


def dealt(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows with the number of their batch, `size` rows each in the order of the keys, within 64 parts by hash, so no task orders all rows."""
    part = Window.partitionBy("_part").orderBy(*keys)
    rows = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(64))).withColumn("_i", F.floor((F.row_number().over(part) - 1) / size))
    return rows.withColumn("batch", F.concat_ws("-", "_part", "_i")).drop("_part", "_i")
