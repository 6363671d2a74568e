"""Queries over penalised additive models and boosted trees, with SQL of what SQL can tell of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import month_index
from ..operators import boosting, gam
from . import bindings as b
from .registry import query, rounded
from .scene_queries import regression_rows

# order lines: price where returned, else zero; half of the quantities large
RETURNS = "r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1000 ELSE 0 END AS y, (l_quantity > 25)::INT AS large FROM lineitem)"


def returns(spark, sf):
    y = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 1000).otherwise(0.0)
    large = (F.col("l_quantity") > 25).cast("double")
    return b.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", y.alias("y"), large.alias("large"))


@query(f"""WITH {RETURNS}, m AS (SELECT avg(y) FILTER (large = 0) AS a, avg(y) FILTER (large = 1) AS b, count(*) AS n FROM r), p AS (SELECT * FROM (VALUES (1.2::DOUBLE), (1.5)) t(power))
    SELECT power, 'one' AS term, round(ln(a), 5) AS estimate, n FROM m, p UNION ALL SELECT power, 'large', round(ln(b / a), 5), n FROM m, p""")
def tweedie_levels(spark, sf):
    """Under a log link a two-level term gives the levels' means, whatever the power."""
    out = []
    for power in (1.2, 1.5):
        got = gam.fit(returns(spark, sf), "y", {}, ["large"], gam.Family("tweedie", power))
        out += [(power, term, float(v), got.stats["n"]) for term, v in zip(("one", "large"), got.beta)]
    return rounded(spark.createDataFrame(out, "power double, term string, estimate double, n long"), estimate=5)


@query("""SELECT count(*) AS n, round(avg(l_linenumber), 4) AS observed, round(avg(l_linenumber), 4) AS expected, count(DISTINCT l_suppkey) AS n_levels, 0::BIGINT AS n_out FROM lineitem""")
def smooth_counts(spark, sf):
    """Counts on smooth terms with an intercept for each supplier: the expected add up to the observed, as the intercept has no penalty."""
    rows = b.table(spark, sf, "lineitem")
    got = gam.fit(rows, "l_linenumber", {"l_extendedprice": 8, "l_quantity": 6}, [], gam.Family("poisson"), group="l_suppkey")
    out = got.predict(rows).agg(F.count("*").alias("n"), F.avg("l_linenumber").alias("observed"), F.avg("predicted").alias("expected"), F.count_if(F.col("predicted") <= 0).alias("n_out"))
    return rounded(out.crossJoin(got.levels.agg(F.count("*").alias("n_levels"))), observed=4, expected=4)  # one row with one row


@query()
def additive_terms(spark, sf):
    """Cover of cells by month as a beta response, with errors that follow one another by the month."""
    rows = regression_rows(spark, sf).withColumn("mi", month_index(F.col("month")))
    return gam.fit(rows, "y", {"x1": 8, "x2": 8}, [], gam.Family("beta"), group="cell", series=["cell"], month="mi", rho=0.3).terms


SPLITS = f"""WITH {RETURNS}, c AS (SELECT y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS predictor, unnest([l_quantity, l_discount, l_tax]) AS x FROM r),
    v AS (SELECT predictor, x, count(*) AS n, sum(y) AS s FROM c GROUP BY 1, 2), w AS (SELECT predictor, x, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(n) OVER (PARTITION BY predictor) AS tn, sum(s) OVER (PARTITION BY predictor) AS ts
    FROM v WINDOW o AS (PARTITION BY predictor ORDER BY x)), g AS (SELECT *, s * s / n + (ts - s) * (ts - s) / (tn - n) - ts * ts / tn AS gain FROM w WHERE n < tn)"""


@query(SPLITS + """ SELECT predictor, round(x, 4) AS cut, round(s / n, 4) AS lower_mean, round((ts - s) / (tn - n), 4) AS upper_mean, CAST(tn AS BIGINT) AS n FROM g QUALIFY row_number() OVER (ORDER BY gain DESC) = 1""")
def best_split(spark, sf):
    """The one split of a response that explains most of its variance."""
    got = boosting.fit(returns(spark, sf), "y", ["l_quantity", "l_discount", "l_tax"], trees=1, depth=1, rate=1.0, bins=128, ridge=0.0, least_rows=1)
    tree = got.trees[0]
    (name, cut), low, high = tree.splits[1], got.start + tree.leaves[2], got.start + tree.leaves[3]
    return rounded(spark.createDataFrame([(name, cut, low, high, got.n)], "predictor string, cut double, lower_mean double, upper_mean double, n long"), cut=4, lower_mean=4, upper_mean=4)


@query(f"""WITH {RETURNS} SELECT model, (l_orderkey % 2)::INT AS fold, count(*) AS n, round(avg(y), 4) AS observed, 0::BIGINT AS n_out FROM r, (VALUES ('tweedie'), ('hurdle')) t(model) GROUP BY 1, 2""")
def boosted_out_of_fold(spark, sf):
    """Every line is scored once by each model, by the fit that left its fold out, above zero."""
    rows = returns(spark, sf).withColumn("fold", (F.col("l_orderkey") % 2).cast("int"))
    got = boosting.held_out(rows, "y", ["l_quantity", "l_discount", "l_tax"], "fold", {"tweedie": boosting.Loss("tweedie", 1.3)}, trees=4, depth=2, rate=0.3)
    out = got.groupBy("model", "fold").agg(F.count("*").alias("n"), F.avg("y").alias("observed"), F.count_if(F.col("predicted").isNull() | (F.col("predicted") <= 0)).alias("n_out"))
    return rounded(out, observed=4)


@query()
def boosted_skill(spark, sf):
    """Deviance of each model out of fold, and of the mean of all lines."""
    rows = returns(spark, sf).withColumn("fold", (F.col("l_orderkey") % 2).cast("int"))
    loss = boosting.Loss("tweedie", 1.3)
    got = boosting.held_out(rows, "y", ["l_quantity", "l_discount", "l_tax"], "fold", {"tweedie": loss}, trees=4, depth=2, rate=0.3)
    mean = F.lit(rows.agg(F.avg("y")).first()[0])
    y = F.col("y")
    return got.groupBy("model").agg(F.count("*").alias("n"), F.avg(loss.deviance(y, F.col("predicted"))).alias("deviance"), F.avg(loss.deviance(y, mean)).alias("deviance_of_mean"))
