"""Queries over guards, corrections and cross-validated classifiers, with SQL of what SQL can tell of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import models, panel, regions, rules, training
from . import bindings as b
from .bindings import LINES, PANEL
from .registry import query, rounded
from .scene_queries import REG, regression_rows


@query("""SELECT o_orderkey, round(-o_totalprice / 1000 + 10 * log10(power(cos(radians(38.0)), 2) / power(cos(radians(25.0 + o_custkey % 20)), 2)), 6) AS decibel FROM orders""")
def angle_corrections(spark, sf):
    got = rules.angle_corrected(-F.col("o_totalprice") / 1000, 25.0 + F.col("o_custkey") % 20)
    return rounded(b.table(spark, sf, "orders").select("o_orderkey", got.alias("decibel")), decibel=6)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 1000 - 200 AS u, o_custkey % 7 - 3.0::DOUBLE AS v, o_orderkey % 5 - 2.0::DOUBLE AS gx, o_orderkey % 3 - 1.0::DOUBLE AS gy FROM orders)
    SELECT o_orderkey, CASE WHEN gx * gx + gy * gy > 0 THEN round(-(u * gx + v * gy) / sqrt(gx * gx + gy * gy), 6) END AS onshore FROM o""")
def onshore_wind(spark, sf):
    k = F.col("o_orderkey")
    got = panel.onshore(b.table(spark, sf, "orders"), F.col("o_totalprice") / 1000 - 200, F.col("o_custkey") % 7 - 3.0, k % 5 - 2.0, k % 3 - 1.0)
    return rounded(got.select("o_orderkey", "onshore"), onshore=6)


@query(f"""WITH {LINES} SELECT cell, count(*) AS n, round(count(*) * 0.12, 4)::DOUBLE AS area_ha FROM lines WHERE l_returnflag = 'R' GROUP BY 1""")
def projected_areas(spark, sf):
    """Target pixels of a sheared affine grid of 1,200 square units a pixel."""
    got = b.lines(spark, sf).filter("l_returnflag = 'R'").groupBy("cell").agg(F.count("*").alias("n"))
    return rounded(got.withColumn("area_ha", F.col("n") * fn.pixel_area_ha(30.0, 5.0, 6.0, -39.0)), area_ha=4)


@query(f"""WITH {PANEL}, c AS (SELECT * FROM (VALUES (0.05::DOUBLE), (0.33), (2.0)) t(configured)), s AS (SELECT configured, avg((cover <= configured)::INT) AS share, quantile_cont(cover, 0.25) AS q FROM panel, c GROUP BY 1)
    SELECT configured, round(share, 6) AS share, round(CASE WHEN share BETWEEN 0.02 AND 0.98 THEN configured ELSE q END, 6) AS threshold, CASE WHEN share BETWEEN 0.02 AND 0.98 THEN 'configured' ELSE 'quantile' END AS origin FROM s""")
def resolved_thresholds(spark, sf):
    p, out = b.panel_table(spark, sf), []
    for cut in (0.05, 0.33, 2.0):
        value, origin = regions.resolve_threshold(p, "cover", cut, 0.25)
        out.append((cut, regions.capture_share(p, "cover", cut), value, origin))
    return rounded(spark.createDataFrame(out, "configured double, share double, threshold double, origin string"), share=6, threshold=6)


@query(f"""WITH {PANEL}, n AS (SELECT count(driver) > 0 AND min(driver) < max(driver) AS driver, count(rain) > 0 AND min(rain) < max(rain) AS rain, count(DISTINCT 1) > 1 AS same, count(DISTINCT n_pixels) > 1 AS n_pixels FROM panel)
    SELECT 'wetness' AS role, 'rain' AS chosen, rain AS usable FROM n UNION ALL SELECT 'load', 'driver', driver FROM n UNION ALL SELECT 'constant', 'same', same FROM n UNION ALL SELECT 'absent', NULL, false FROM n""")
def covariate_choice(spark, sf):
    """The first column of each role that the panel has, and whether it varies."""
    p = b.panel_table(spark, sf).withColumn("same", F.lit(1))
    chosen = regions.choose_columns(p, {"wetness": ["soil", "rain", "n_pixels"], "load": ["driver", "rain"], "constant": ["same"], "absent": ["wind"]})
    usable = set(panel.usable_columns(p, [c for c in chosen.values() if c]))
    return spark.createDataFrame([(r, c, c in usable) for r, c in chosen.items()], "role string, chosen string, usable boolean")


@query(r"""SELECT column_name AS "column", CASE WHEN column_name = 'l_tax' THEN 'ok' WHEN regexp_full_match(lower(column_name), 'l_extendedprice|l_(tax|quantity)|.*_target') THEN 'response' WHEN regexp_full_match(lower(column_name), '.*(discount|confidence).*') THEN 'confidence' ELSE 'ok' END AS reason
    FROM (DESCRIBE lineitem)""")
def column_guards(spark, sf):
    return rules.guarded_columns(b.table(spark, sf, "lineitem"), ["l_extendedprice", "l_(tax|quantity)", ".*_target"], [".*(discount|confidence).*"], ["l_tax"])


@query("""SELECT CASE WHEN s IS NULL THEN 'unreadable' WHEN s < 20000 THEN 'too small' WHEN trim(tag) = '' THEN 'no tag' WHEN tag NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'other run' WHEN v IS NULL OR v < 3 THEN 'old version' ELSE 'ok' END AS reason, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS s, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS tag, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 END AS v FROM orders) GROUP BY 1""")
def provenance_reasons(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 7
    files = b.table(spark, sf, "orders").select("o_orderkey", F.when(k % 11 > 0, F.col("o_totalprice")).alias("size"), F.when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("tag"), F.when(c > 0, c).alias("version"))
    got = rules.provenance_reasons(files, "size", "tag", "version", 20000, ["1-URGENT", "2-HIGH", "5-LOW"], 3)
    return got.groupBy("reason").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


# --- classifiers: rows of order lines, their return flag the class, folds by order ------------------------------------------------

PREDICTORS = ["l_quantity", "l_discount", "l_tax"]
LABELLED = "rows AS (SELECT l_orderkey AS point, l_orderkey % 3 AS fold, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS label FROM lineitem)"


def labelled(spark, sf):
    label = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point"), (F.col("l_orderkey") % 3).cast("int").alias("fold"), label.alias("label"), *(F.col(c).cast("double").alias(c) for c in PREDICTORS))


@query(f"""WITH {LABELLED}, n AS (SELECT label, count(*) AS n FROM rows GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n), 9)::DOUBLE AS weight FROM n""")
def class_weights(spark, sf):
    got = models.balanced(labelled(spark, sf)).groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    return rounded(got, weight=9)


@query(f"""WITH {LABELLED} SELECT model, fold::INT AS fold, count(*) AS n, count(DISTINCT point) AS n_points, sum(label) AS labels, count(*) AS n_known FROM rows, (VALUES ('logistic'), ('weighted_logistic')) t(model) GROUP BY 1, 2""")
def out_of_fold_rows(spark, sf):
    """Every row is predicted once by each model, by the fit that left its fold out, as one of the classes."""
    names = ["logistic", "weighted_logistic"]
    got, _ = models.cross_validate(labelled(spark, sf), PREDICTORS, {n: models.candidates()[n] for n in names})
    return got.groupBy("model", "fold").agg(F.count("*").alias("n"), F.countDistinct("point").alias("n_points"), F.sum("label").alias("labels"), F.count_if(F.col("predicted").isin(0, 1, 2)).alias("n_known"))


@query(f"""WITH {LABELLED} SELECT fold::INT AS fold, count(*) AS n, count(*) AS n_sure, 0::BIGINT AS n_unlike FROM rows GROUP BY 1""")
def scored_pixels(spark, sf):
    """Pixels scored by a classifier fitted on one fold: the winner's share of three classes is a third at least, and the same pixel scores alike."""
    rows = labelled(spark, sf)
    fit = models.fitted(models.candidates()["weighted_logistic"], PREDICTORS, rows.filter("fold = 0"))
    got = models.score(fit, rows)
    alike = got.groupBy(*PREDICTORS).agg((F.countDistinct("class", "probability") > 1).alias("unlike"))
    return got.join(alike, PREDICTORS).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("probability").between(33, 100)).alias("n_sure"), F.count_if("unlike").alias("n_unlike"))


@query(f"""WITH {LABELLED} SELECT arm, fold::INT AS fold, count(*) AS n FROM rows, (VALUES ('all'), ('even')) t(arm) WHERE label > 0 GROUP BY 1, 2""")
def scope_ablation(spark, sf):
    """One model trained on all rows and on those of even orders, tested on the same rows."""
    got = training.scope_ablation(labelled(spark, sf), PREDICTORS, "logistic", {"all": F.lit(True), "even": F.col("point") % 2 == 0}, F.col("label") > 0)
    return got.select("arm", "fold", "n")


@query(f"""WITH {REG}, i AS (SELECT max(y) AS m, count(*) AS n FROM z) SELECT n, 0::BIGINT AS n_out, 0::BIGINT AS n_falls FROM i""")
def isotonic_calibration(spark, sf):
    """A rising map of x1 to y: never outside the range of y, and never falling."""
    from pyspark.sql import Window

    rows = regression_rows(spark, sf).select("x1", "y")
    got = models.calibrate(rows, "x1", "y").transform(rows)
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    by = Window.partitionBy(F.lit(0)).orderBy("x1", "prediction")  # a row for each cell and month
    return got.withColumn("_d", F.col("prediction") - F.lag("prediction").over(by)).agg(F.count("*").alias("n"), F.count_if((F.col("prediction") < low - 1e-9) | (F.col("prediction") > high + 1e-9)).alias("n_out"), F.count_if(F.col("_d") < -1e-9).alias("n_falls"))
