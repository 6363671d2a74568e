"""Classifiers and calibrations by pyspark.ml: candidates, validation by folds, scoring, importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize
from .metrics import metric_suite

ROWS = "_rows"  # of rows alike, how many they are


def candidates(seed: int = 42) -> dict:
    """Estimators by name; class weights are taken from the column `weight`."""
    return {
        "logistic": LogisticRegression(labelCol="label", maxIter=50, regParam=0.01),
        "weighted_logistic": LogisticRegression(labelCol="label", maxIter=50, regParam=0.01, weightCol="weight"),
        "forest": RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=8, seed=seed),
        "weighted_forest": RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=8, seed=seed, weightCol="weight"),
        "boosting": OneVsRest(classifier=GBTClassifier(maxIter=15, maxDepth=3, seed=seed), labelCol="label"),
    }


def balanced(df: DataFrame, label: str = "label", count: str | None = None) -> DataFrame:
    """Adds `weight`: rows over classes times rows of the class. count: a column that tells how many rows each stands for."""
    n = df.groupBy(label).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n.join(F.broadcast(total))), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def pipeline(estimator, predictors: list[str]) -> Pipeline:
    """Median imputation, scaling and the estimator."""
    filled = [f"{p}_filled" for p in predictors]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=predictors, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), estimator])


def alike(df: DataFrame, predictors: list[str], *more: str, label: str = "label") -> DataFrame:
    """Rows with the same predictors, label and further columns as one, `_rows` of them, as a table: what fits by sums over rows need of df."""
    return materialize(df.groupBy(*more, label, *predictors).agg(F.count("*").alias(ROWS)), "rows-alike")


def lacking(predictors: list[str]) -> Column:
    """Whether a predictor is null or not a number."""
    return reduce(lambda a, b: a | b, (F.col(p).isNull() | F.isnan(F.col(p).cast("double")) for p in predictors))


def by_counts(estimator) -> bool:
    """Whether the estimator's fit to rows is that to rows alike with their number as a weight: logistic regression, with class weights or none."""
    return isinstance(estimator, LogisticRegression) and (not estimator.isSet("weightCol") or estimator.getWeightCol() == "weight") and (estimator.getLabelCol(), estimator.getFeaturesCol()) == ("label", "features")


def fitted(estimator, predictors: list[str], rows: DataFrame, counted: DataFrame | None = None, complete: bool = False) -> PipelineModel:
    """The pipeline fitted to rows with `balanced` weights.

    Logistic regression is fitted to rows alike (`counted`, which is made if it is not given), weighted by their number: the same sums, from
    as many rows as there are different ones. Predictors are scaled here by their deviation under the weights of single rows, as the regression does
    itself, whose penalty is then on them as they are. complete: no predictor is lacking, here or in what is predicted, so no medians are needed.
    """
    if not by_counts(estimator):
        return pipeline(estimator, predictors).fit(balanced(rows))
    every = balanced((alike(rows, predictors) if counted is None else counted).filter("label is not null"), count=ROWS)
    middle = {} if complete else Imputer(strategy="median", inputCols=[f"_f{i}" for i in range(len(predictors))], outputCols=[f"_g{i}" for i in range(len(predictors))]).fit(
        rows.filter("label is not null").select(*(F.col(p).cast("double").alias(f"_f{i}") for i, p in enumerate(predictors)))).surrogateDF.first().asDict()
    value = [f"CAST(`{p}` AS DOUBLE)" if complete else f"coalesce(nanvl(CAST(`{p}` AS DOUBLE), NULL), {middle[f'_f{i}']!r}D)" for i, p in enumerate(predictors)]
    single = F.col("weight") if estimator.isSet("weightCol") else F.lit(1.0)
    w = F.col(ROWS) * single
    first = every.agg(F.sum(w).alias("w"), F.sum(w * single).alias("ww"), *(F.sum(w * F.expr(v)).alias(f"m{i}") for i, v in enumerate(value))).first()
    mean = [first[f"m{i}"] / first["w"] for i in range(len(value))]
    square = every.agg(*(F.sum(w * F.pow(F.expr(v) - F.lit(m), 2)).alias(f"s{i}") for i, (v, m) in enumerate(zip(value, mean)))).first()
    free = first["w"] - first["ww"] / first["w"]
    scale = [(free / s) ** 0.5 if free > 0 and s > 0 else 0.0 for s in square]
    scaled = ", ".join(f"({v} - ({m!r}D)) * {c!r}D AS `{p}_scaled`" for v, m, c, p in zip(value, mean, scale, predictors))
    ready = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=[f"{p}_scaled" for p in predictors], outputCol="features")]
    known = PipelineModel(ready).transform(every.withColumn("_weight", w))
    return PipelineModel([*ready, estimator.copy({estimator.weightCol: "_weight", estimator.standardization: False} if estimator.getStandardization() else {estimator.weightCol: "_weight"}).fit(known)])


def cross_validate(df: DataFrame, predictors: list[str], models: dict, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of every model, and their metrics by model and fold. Folds are few; their fits run side by side, those of logistic regression from one table of rows alike."""
    counted = alike(df, predictors, fold) if any(map(by_counts, models.values())) else None
    known = df if counted is None else counted
    complete = counted is not None and counted.filter(lacking(predictors)).isEmpty()
    folds = sorted(r[0] for r in known.select(fold).distinct().collect())

    def held_out(name: str, f) -> DataFrame:
        fit = fitted(models[name], predictors, df.filter(F.col(fold) != f), None if counted is None else counted.filter(F.col(fold) != f), complete)
        return fit.transform(df.filter(F.col(fold) == f)).select(*df.columns, F.col("prediction").cast("int").alias("predicted"), F.lit(name).alias("model"))

    out = reduce(DataFrame.unionByName, side_by_side(held_out, [(name, f) for name in models for f in folds]))
    classes = sorted(int(r[0]) for r in known.select("label").distinct().collect())
    if counted is not None:
        delete(df.sparkSession, counted._table_path)
    return out, metric_suite(out, ["model", fold], "label", "predicted", classes)


def side_by_side(fit, tasks: list[tuple], at_once: int = 4) -> list:
    """Calls of fit, several at a time, as each waits for Spark jobs of its own."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda t: fit(*t), tasks))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted class and the winner's probability in whole percent."""
    got = model.transform(df)
    return got.select(*df.columns, F.col("prediction").cast("int").alias("class"), F.round(100 * F.array_max(vector_to_array("probability"))).cast("int").alias("probability"))


def importance(model, predictors: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or mean absolute coefficients, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    return sorted(zip(predictors, map(float, values)), key=lambda t: (-t[1], t[0]))


def permutation_importance(model, df: DataFrame, predictors: list[str], label: str, seed: int = 0) -> list[tuple[str, float]]:
    """How much the squared error grows when a column's values are dealt out anew, in hash order."""
    from pyspark.sql import Window

    def error(rows: DataFrame) -> float:
        return rows.select(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).first()[0]

    base, out = error(model.transform(df)), []
    part = Window.partitionBy("_part")
    for p in predictors:
        rows = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        rows = rows.withColumn("_i", F.row_number().over(part.orderBy(*df.columns)))
        other = rows.select("_part", F.row_number().over(part.orderBy(F.xxhash64(F.lit(seed), p, "_i"))).alias("_i"), F.col(p).alias("_p"))
        out.append((p, error(model.transform(rows.join(other, ["_part", "_i"]).withColumn(p, F.col("_p")))) - base))
    return sorted(out, key=lambda t: -t[1])


def calibrate(df: DataFrame, x: str, y: str, how: str = "isotonic"):
    """A fitted map of one source's values to another's: isotonic, linear or None for identity."""
    if how == "identity":
        return None
    est = IsotonicRegression(featuresCol=x, labelCol=y) if how == "isotonic" else LinearRegression(featuresCol="_f", labelCol=y, solver="normal")
    rows = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna()
    return est.fit(rows) if how == "isotonic" else Pipeline(stages=[VectorAssembler(inputCols=[x], outputCol="_f"), est]).fit(rows)


def hurdle(train: DataFrame, test: DataFrame, predictors: list[str], y: str, seed: int = 1) -> DataFrame:
    """P(present) times the expected value where present, by boosted trees."""
    va = VectorAssembler(inputCols=predictors, outputCol="features")
    tr, te = va.transform(train.withColumn("_present", (F.col(y) > 0).cast("double"))), va.transform(test)
    c = GBTClassifier(labelCol="_present", maxIter=15, maxDepth=3, seed=seed).fit(tr)
    r = GBTRegressor(labelCol=y, maxIter=15, maxDepth=3, seed=seed).fit(tr.filter("_present = 1"))
    out = c.transform(te).withColumn("_p", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
    return r.transform(out).withColumn("predicted", F.col("_p") * F.greatest(F.col("prediction"), F.lit(0.0))).select(*test.columns, "predicted")


def tweedie(train: DataFrame, predictors: list[str], y: str, power: float = 1.5):
    """A Tweedie regression with a log link."""
    va = VectorAssembler(inputCols=predictors, outputCol="features")
    return Pipeline(stages=[va, GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=y, regParam=1e-3)]).fit(train)


def elastic_net(df: DataFrame, predictors: list[str], y: str, ratio: float, penalty: float) -> list[tuple[str, float]]:
    """Coefficients under an elastic net on scaled predictors."""
    va, sc = VectorAssembler(inputCols=predictors, outputCol="_r"), StandardScaler(inputCol="_r", outputCol="features", withMean=True)
    fit = Pipeline(stages=[va, sc, LinearRegression(labelCol=y, elasticNetParam=ratio, regParam=penalty)]).fit(df)
    return list(zip(predictors, map(float, fit.stages[-1].coefficients)))
