"""Queries over pixels, classifications, agreement and skill, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import areas, metrics, rules
from . import bindings as b
from .bindings import LINES, PIXELS
from .panel_queries import CLIMATOLOGY, PANEL, BY_SENSOR, _by_sensor, split_panel
from .registry import query, rounded

SCENE = ["sensor", "month"]
CLASSES = {0: "water", 1: "land", 2: "floating"}
DENSE = "cls AS (SELECT * FROM (VALUES (0), (1), (2)) t(c))"


@query(f"""WITH {PIXELS}, s AS (SELECT DISTINCT sensor, month FROM pixels), k AS (SELECT * FROM (VALUES (0, 'water'), (1, 'land'), (2, 'floating')) t(model, class_name)),
    n AS (SELECT sensor, month, model, count(*) AS n FROM pixels GROUP BY 1, 2, 3)
    SELECT sensor, month, model, class_name, coalesce(n, 0) AS n_pixels, round(coalesce(n, 0) * 0.09, 6)::DOUBLE AS area_ha, round(coalesce(n, 0) * 0.0009, 6)::DOUBLE AS area_km2 FROM s CROSS JOIN k LEFT JOIN n USING (sensor, month, model)""")
def class_area_zero_filled(spark, sf):
    return rounded(areas.class_area(b.pixels(spark, sf), SCENE, "model", CLASSES, 900.0), area_ha=6, area_km2=6)


@query(f"""WITH {PIXELS} SELECT sensor, month, count(*) FILTER (WHERE model = 2) AS n_target, count(model) AS n_valid, round(100.0 * count(*) FILTER (WHERE model = 2) / count(model), 6)::DOUBLE AS cover_percent FROM pixels GROUP BY 1, 2""")
def raster_metrics(spark, sf):
    return rounded(areas.raster_metrics(b.pixels(spark, sf), SCENE, "model", 2), cover_percent=6)


@query(f"""WITH {PIXELS}, t AS (SELECT * FROM (VALUES (0.9::DOUBLE), (0.93), (0.95), (0.98)) t(threshold))
    SELECT sensor, model, threshold, count(*) FILTER (WHERE probability >= threshold * 100) AS n_pixels, round(count(*) FILTER (WHERE probability >= threshold * 100) * 0.09, 6)::DOUBLE AS area_ha FROM pixels CROSS JOIN t GROUP BY 1, 2, 3""")
def confidence_area(spark, sf):
    return rounded(areas.confident_area(b.pixels(spark, sf), ["sensor"], "model", "probability", [0.9, 0.93, 0.95, 0.98], 900.0), area_ha=6)


@query(f"""WITH {PIXELS}, e AS (SELECT sensor, month, count(*) FILTER (WHERE model = 2 AND probability IS NOT NULL) AS h, coalesce(sum(CASE WHEN model = 2 THEN probability / 100.0 END), 0.0) AS s FROM pixels GROUP BY 1, 2)
    SELECT sensor, month, h AS hard_pixels, round(h * 0.09, 9)::DOUBLE AS hard_ha, round(s * 0.09, 9)::DOUBLE AS soft_ha, round((h - s) * 0.09, 9)::DOUBLE AS gap_ha, CASE WHEN h > 0 THEN round(s / h, 9)::DOUBLE END AS mean_probability FROM e""")
def hard_soft_envelope(spark, sf):
    return rounded(areas.hard_soft(b.pixels(spark, sf), SCENE, "model", "probability", 2, 900.0), hard_ha=9, soft_ha=9, gap_ha=9, mean_probability=9)


@query(f"""WITH {PIXELS} SELECT cell, month, round(coalesce(sum(CASE WHEN model = 2 THEN coalesce(probability / 100.0, 1.0) END), 0.0), 9)::DOUBLE AS soft_target, count(model) AS n_valid,
    round(coalesce(sum(CASE WHEN model = 2 THEN coalesce(probability / 100.0, 1.0) END), 0.0) / count(model), 9)::DOUBLE AS soft_cover FROM pixels GROUP BY 1, 2""")
def zonal_soft(spark, sf):
    return rounded(areas.zonal_soft(b.pixels(spark, sf), ["cell", "month"], "model", "probability", 2), soft_target=9, soft_cover=9)


@query(f"""WITH {PIXELS} SELECT sensor, month, CAST(floor((pixel - 0) / 500) AS BIGINT) AS cell, count(*) FILTER (WHERE model = 2) AS n_target, count(model) AS n_valid,
    round(100.0 * count(*) FILTER (WHERE model = 2) / count(model), 6)::DOUBLE AS cover_percent FROM pixels GROUP BY 1, 2, 3""")
def zonal_counts(spark, sf):
    return rounded(areas.zonal_counts(b.pixels(spark, sf), SCENE, fn.cell_of(F.col("pixel"), 0, 500), "model", 2), cover_percent=6)


@query(f"""WITH {LINES}, t AS (SELECT l_orderkey AS pixel, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 255 ELSE 0 END AS model, {{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_returnflag}} AS place FROM lines)
    SELECT pixel, coalesce(arg_min(model, place) FILTER (WHERE model <> 255), 255)::INT AS model FROM t GROUP BY 1""")
def mosaic_tiles(spark, sf):
    model = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 255).otherwise(0)
    t = b.lines(spark, sf).withColumnRenamed("l_orderkey", "pixel").withColumn("model", model)
    return areas.mosaic(t, ["pixel"], "model", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])  # line numbers repeat within an order


@query(f"""WITH {PIXELS} SELECT month, sum(CASE WHEN sensor = 'S1' THEN 0.09 END)::DOUBLE AS "S1", sum(CASE WHEN sensor = 'S2' THEN 0.09 END)::DOUBLE AS "S2" FROM pixels WHERE model = 2 GROUP BY 1""".replace("sum(CASE WHEN sensor = 'S1' THEN 0.09 END)::DOUBLE", "round(sum(CASE WHEN sensor = 'S1' THEN 0.09 END), 4)::DOUBLE").replace("sum(CASE WHEN sensor = 'S2' THEN 0.09 END)::DOUBLE", "round(sum(CASE WHEN sensor = 'S2' THEN 0.09 END), 4)::DOUBLE"))
def wide_area_table(spark, sf):
    p = b.pixels(spark, sf).filter("model = 2").withColumn("ha", F.lit(0.09))
    return rounded(areas.wide_areas(p, ["month"], ["S1", "S2"], "sensor", "ha"), S1=4, S2=4)


@query(f"""WITH {PIXELS} SELECT sensor, month, count(probability) AS n_valid, count(*) AS n_pixels, round(count(probability) / count(*), 6) AS valid_fraction, (count(probability) / count(*) >= 0.85 AND count(probability) >= 150) AS passes FROM pixels GROUP BY 1, 2""")
def scene_valid_gate(spark, sf):
    return rounded(areas.scene_gate(b.pixels(spark, sf), SCENE, F.col("probability").isNotNull(), 0.85, 150), valid_fraction=6)


@query(f"""WITH {PIXELS}, n AS (SELECT sensor, month, count(*) AS n FROM pixels GROUP BY 1, 2) SELECT sensor, month, n, CAST(sum(n) OVER (PARTITION BY sensor ORDER BY month) AS BIGINT) AS total FROM n""")
def cumulative_exports(spark, sf):
    n = b.pixels(spark, sf).groupBy("sensor", "month").agg(F.count("*").alias("n"))
    return areas.running_total(n, ["sensor"], "month", "n", "total")


@query(f"""WITH {PIXELS}, {DENSE}, s AS (SELECT DISTINCT sensor FROM pixels), n AS (SELECT sensor, rule AS truth, model AS predicted, count(*) AS n FROM pixels GROUP BY 1, 2, 3),
    d AS (SELECT sensor, a.c AS truth, q.c AS predicted, coalesce(n, 0) AS n FROM s CROSS JOIN cls a CROSS JOIN cls q LEFT JOIN n ON n.sensor = s.sensor AND n.truth = a.c AND n.predicted = q.c)
    SELECT s.sensor, truth, predicted, n, round(n / nullif(sum(n) OVER (PARTITION BY s.sensor, truth), 0), 6)::DOUBLE AS row_share FROM d s""".replace("SELECT sensor, a.c AS truth, q.c AS predicted, coalesce(n, 0) AS n FROM s", "SELECT s.sensor, a.c AS truth, q.c AS predicted, coalesce(n, 0) AS n FROM s"))
def confusion_long(spark, sf):
    return rounded(metrics.confusion(b.pixels(spark, sf), ["sensor"], "rule", "model", [0, 1, 2]), row_share=6)


AGREE = """x AS (SELECT {k}, count(*) AS n, count(*) FILTER (WHERE model = rule) AS same, count(*) FILTER (WHERE model = 2 AND rule = 2) AS n_both, count(*) FILTER (WHERE model = 2 OR rule = 2) AS n_either,
        (count(*) FILTER (WHERE model = 0) * count(*) FILTER (WHERE rule = 0) + count(*) FILTER (WHERE model = 1) * count(*) FILTER (WHERE rule = 1) + count(*) FILTER (WHERE model = 2) * count(*) FILTER (WHERE rule = 2)) / (count(*)::DOUBLE * count(*)) AS pe
    FROM pixels GROUP BY ALL)"""


@query(f"""WITH {PIXELS}, {AGREE.format(k='sensor, month')} SELECT sensor, month, n, round(same / n, 6) AS agreement, CASE WHEN abs(1 - pe) > 1e-12 THEN round((same / n - pe) / (1 - pe), 6) END AS kappa,
    CASE WHEN n_either > 0 THEN round(n_both / n_either, 6) END AS jaccard, CASE WHEN n_either + n_both > 0 THEN round(2.0 * n_both / (n_either + n_both), 6)::DOUBLE END AS dice FROM x""")
def scene_agreement(spark, sf):
    return rounded(metrics.agreement(b.pixels(spark, sf), SCENE, "model", "rule", [0, 1, 2], 2), agreement=6, kappa=6, jaccard=6, dice=6)


PER_CLASS = f"""{DENSE}, pc AS (SELECT sensor, c AS class, count(*) FILTER (WHERE rule = c) AS support, coalesce(count(*) FILTER (WHERE rule = c AND model = c) / nullif(count(*) FILTER (WHERE model = c), 0), 0) AS pr,
        coalesce(count(*) FILTER (WHERE rule = c AND model = c) / nullif(count(*) FILTER (WHERE rule = c), 0), 0) AS rc FROM pixels CROSS JOIN cls GROUP BY 1, 2),
    pf AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f FROM pc)"""


@query(f"WITH {PIXELS}, {PER_CLASS} SELECT sensor, class, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1 FROM pf")
def per_class_metrics(spark, sf):
    return rounded(metrics.per_class(b.pixels(spark, sf), ["sensor"], "rule", "model", [0, 1, 2]), precision=6, recall=6, f1=6)


@query(f"""WITH {PIXELS}, {PER_CLASS}, {AGREE.format(k='sensor')}, m AS (SELECT sensor, avg(rc) FILTER (WHERE support > 0) AS ba, avg(f) AS mf, sum(f * support) / sum(support) AS wf FROM pf GROUP BY 1)
    SELECT sensor, n, round(same / n, 6) AS accuracy, round((same / n - pe) / (1 - pe), 6) AS kappa, round(ba, 6) AS balanced_accuracy, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1 FROM x JOIN m USING (sensor)""")
def metric_suite(spark, sf):
    return rounded(metrics.metric_suite(b.pixels(spark, sf), ["sensor"], "rule", "model", [0, 1, 2]), accuracy=6, kappa=6, balanced_accuracy=6, macro_f1=6, weighted_f1=6)


BINS = ["0-500", "500-2000", "2000-8000", "8000-inf"]


@query(f"""WITH {PIXELS}, l AS (SELECT *, CASE WHEN pixel >= 8000 THEN '8000-inf' WHEN pixel >= 2000 THEN '2000-8000' WHEN pixel >= 500 THEN '500-2000' ELSE '0-500' END AS bin FROM pixels),
    k AS (SELECT * FROM (VALUES (0, '0-500'), (1, '500-2000'), (2, '2000-8000'), (3, '8000-inf'), (4, 'beyond')) t(bin_order, bin)),
    g AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE rule = 2 AND model = 2) AS tp, count(*) FILTER (WHERE rule = 2) AS support, count(*) FILTER (WHERE model = 2) AS n_predicted FROM l GROUP BY 1)
    SELECT bin_order, bin, coalesce(n, 0) AS n, coalesce(support, 0) AS support, coalesce(n_predicted, 0) AS n_predicted, round(tp / nullif(n_predicted, 0), 6) AS precision, round(tp / nullif(support, 0), 6) AS recall FROM k LEFT JOIN g USING (bin)""")
def binned_strata(spark, sf):
    p = b.pixels(spark, sf).withColumn("bin", fn.left_closed_bin(F.col("pixel"), [0, 500, 2000, 8000, float("inf")], BINS))
    return rounded(metrics.strata(p, [*BINS, "beyond"], "bin", "rule", "model", 2), precision=6, recall=6)


@query(f"""WITH {PIXELS} SELECT CASE WHEN model = rule THEN 0 ELSE 10 * (model + 1) + rule + 1 END AS code, count(*) AS n, count(*) FILTER (WHERE probability < 95) AS n_unsure, count(*) FILTER (WHERE model <> rule AND probability < 95) AS n_both FROM pixels GROUP BY 1""")
def disagreement_masks(spark, sf):
    m = rules.review_masks(F.col("model"), F.col("rule"), F.col("probability"), 95)
    p = b.pixels(spark, sf).select(rules.disagreement_code(F.col("model"), F.col("rule")).alias("code"), *(c.alias(n) for n, c in m.items()))
    return p.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("unsure") == 1).alias("n_unsure"), F.count_if(F.col("both") == 1).alias("n_both"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount - 0.02 END AS a, l_tax - 0.03 AS i, l_quantity / 50 AS m, -10 - l_quantity / 5 AS p5, -12 - l_discount * 40 AS vh FROM lineitem)
    SELECT CASE WHEN a IS NULL OR i IS NULL OR m IS NULL THEN 255 WHEN a < 0 THEN 1 WHEN i >= 0 THEN 0 WHEN m >= 0.63 THEN 3 WHEN m >= 0.1 THEN 2 ELSE 1 END AS optical,
        CASE WHEN p5 > -17 THEN 1 WHEN vh > -14 THEN 2 ELSE 0 END AS radar, count(*) AS n FROM r GROUP BY 1, 2""")
def s1_s2_rules(spark, sf):
    li = b.table(spark, sf, "lineitem")
    a, i, m = F.when(F.col("l_tax") > 0, F.col("l_discount") - 0.02), F.col("l_tax") - 0.03, F.col("l_quantity") / 50
    radar = rules.radar_class(-10 - F.col("l_quantity") / 5, -12 - F.col("l_discount") * 40)
    return li.select(rules.optical_class(a, i, m).alias("optical"), radar.alias("radar")).groupBy("optical", "radar").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS INT) AS c, -10 - l_quantity / 5 AS p5, -12 - l_discount * 40 AS vh FROM lineitem)
    SELECT c AS predicted, CASE WHEN p5 > -17 THEN 1 WHEN c = 2 AND NOT vh > -14 THEN 0 ELSE c END AS constrained, count(*) AS n FROM r GROUP BY 1, 2""")
def radar_constraint(spark, sf):
    c = rules.label_code(F.col("l_returnflag"), {"N": 0, "A": 1, "R": 2})
    out = rules.constrain_radar(c, -10 - F.col("l_quantity") / 5, -12 - F.col("l_discount") * 40)
    return b.table(spark, sf, "lineitem").select(c.alias("predicted"), out.alias("constrained")).groupBy("predicted", "constrained").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS blue, l_tax AS green, l_quantity / 100 AS red, l_extendedprice / 1e5 AS nir, l_discount + l_tax AS swir1, l_tax / 2 AS swir2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((nir - red) / nullif(nir + red, 0), 9) AS ndvi, round((nir - swir1) / nullif(nir + swir1, 0), 9) AS ndmi, round((green - swir1) / nullif(green + swir1, 0), 9) AS mndwi,
        round(blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2, 9) AS awei, round(4 * (green - swir1) - (0.25 * nir + 2.75 * swir2), 9) AS awei_nsh FROM x""")
def spectral_indices(spark, sf):
    c = F.col
    got = rules.spectral_indices(c("l_discount"), c("l_tax"), c("l_quantity") / 100, c("l_extendedprice") / 1e5, c("l_discount") + c("l_tax"), c("l_tax") / 2)
    return rounded(b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(n) for n, v in got.items())), **dict.fromkeys(got, 9))


@query(f"""WITH {BY_SENSOR} SELECT count(*) AS n, round(avg(a - c), 6) AS mean_bias, round(median(a - c), 6) AS median_bias, round(corr(a, c), 6) AS pearson FROM (SELECT s2.cover AS a, s1.cover AS c FROM s2 JOIN s1 USING (cell, month))""")
def sensor_agreement(spark, sf):
    from ..operators import panel

    o = panel.overlap(*_by_sensor(spark, sf), ["cell", "month"], "cover")
    return rounded(metrics.source_agreement(o, [], "first_value", "second_value"), mean_bias=6, median_bias=6, pearson=6)


@query(f"""WITH {BY_SENSOR}, o AS (SELECT coalesce(s2.cell, s1.cell) AS cell, s2.cover AS a, s1.cover AS c FROM s2 FULL JOIN s1 USING (cell, month))
    SELECT cell, count(a - c) AS n, round(CASE WHEN min(CASE WHEN c IS NOT NULL THEN a END) < max(CASE WHEN c IS NOT NULL THEN a END) AND min(CASE WHEN a IS NOT NULL THEN c END) < max(CASE WHEN a IS NOT NULL THEN c END) THEN corr(a, c) END, 6) AS pearson, round(avg(a - c), 6) AS bias, round(sqrt(avg((a - c) ** 2)), 6) AS rmse,
        round(quantile_cont(a - c, 0.05), 6) AS p5, round(quantile_cont(a - c, 0.5), 6) AS p50, round(quantile_cont(a - c, 0.95), 6) AS p95, count(*) FILTER (WHERE a IS NOT NULL AND c IS NULL) AS only_local, count(*) FILTER (WHERE a IS NULL AND c IS NOT NULL) AS only_reference FROM o GROUP BY 1""")
def pair_comparison(spark, sf):
    a, c = _by_sensor(spark, sf)
    o = a.withColumnRenamed("cover", "a").join(c.withColumnRenamed("cover", "c"), ["cell", "month"], "full_outer")
    return rounded(metrics.comparison(o, ["cell"], "a", "c"), pearson=6, bias=6, rmse=6, p5=6, p50=6, p95=6)


RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"


@query(f"""WITH {PANEL}, r AS (SELECT cell, {RANKED.format(k='cell', x='cover')} AS a, {RANKED.format(k='cell', x='rain')} AS c FROM panel)
    SELECT cell, count(*) AS n, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(c) < max(c) THEN round(corr(a, c), 6) END AS spearman FROM r GROUP BY 1""")
def spearman_by_group(spark, sf):
    return rounded(metrics.spearman(b.panel(spark, sf), ["cell"], "cover", "rain"), spearman=6)


ACF = f"""{PANEL}, d AS (SELECT cell, mi, cover - avg(cover) OVER (PARTITION BY cell) AS d FROM panel), t AS (SELECT cell, sum(d * d) AS ss, count(*) AS n FROM d GROUP BY 1),
    acf AS (SELECT x.cell, x.mi - y.mi AS lag, count(*) AS n_pairs, sum(x.d * y.d) AS s FROM d x JOIN d y ON x.cell = y.cell AND x.mi - y.mi BETWEEN 1 AND 6 GROUP BY 1, 2)"""


@query(f"WITH {ACF} SELECT cell, lag, n_pairs, n, round(s / nullif(ss, 0), 6) AS acf FROM acf JOIN t USING (cell)")
def acf_calendar(spark, sf):
    return rounded(metrics.autocorrelation(b.panel_table(spark, sf), ["cell"], "cover", 6), acf=6)


@query(f"WITH {ACF} SELECT cell, round(sum(n::DOUBLE * (n + 2) * (s / ss) ** 2 / nullif(n - lag, 0)), 5) AS q, count(*) AS df FROM acf JOIN t USING (cell) WHERE ss > 0 AND n_pairs > 2 GROUP BY 1")
def ljung_box(spark, sf):
    return rounded(metrics.ljung_box(metrics.autocorrelation(b.panel_table(spark, sf), ["cell"], "cover", 6), ["cell"]), q=5)


@query(f"""WITH {PANEL}, p AS (SELECT x.cell, x.mi - y.mi AS lag, y.rain AS d, x.cover AS r FROM panel x JOIN panel y ON x.cell = y.cell AND x.mi - y.mi BETWEEN 0 AND 4)
    SELECT cell, CAST(lag AS INT) AS lag, count(*) AS n_pairs, CASE WHEN count(*) >= 8 AND min(d) < max(d) AND min(r) < max(r) THEN round(corr(d, r), 6) END AS ccf FROM p GROUP BY 1, 2""")
def ccf_calendar(spark, sf):
    return rounded(metrics.cross_correlation(b.panel_table(spark, sf), ["cell"], "rain", "cover", 4), ccf=6)


SKILL = f"""{CLIMATOLOGY}, sk AS (SELECT c.cell, c.month, c.valid, c.cover AS observed, c.climatology, l.cover AS persistence FROM clim c JOIN panel l ON l.cell = c.cell AND l.mi = c.mi - 1)"""


def _skill(spark, sf):
    from ..operators import calendar

    clim = split_panel(spark, sf)[2]
    lag = calendar.calendar_lag(b.panel_table(spark, sf).select("cell", "month", "cover"), ["cell"], ["cover"]).select("cell", "month", F.col("cover_lag1").alias("persistence"))
    return clim.join(lag, ["cell", "month"]).filter("persistence is not null").select("cell", "month", "valid", F.col("cover").alias("observed"), "climatology", "persistence")


@query(f"""WITH {SKILL} SELECT count(*) AS n, round(sqrt(avg((climatology - observed) ** 2)), 6) AS rmse, round(avg(abs(climatology - observed)), 6) AS mae, round(avg(climatology - observed), 6) AS bias,
    round(1 - avg((climatology - observed) ** 2) / avg((persistence - observed) ** 2), 6) AS skill, round(sqrt(sum(valid * (climatology - observed) ** 2) / sum(valid)), 6) AS weighted_rmse FROM sk""")
def baseline_skill(spark, sf):
    e, w = metrics.errors("observed", "climatology"), metrics.errors("observed", "climatology", "valid")
    out = _skill(spark, sf).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in e.items()), metrics.skill("observed", "climatology", "persistence").alias("skill"), w["rmse"].alias("weighted_rmse"))
    return rounded(out, rmse=6, mae=6, bias=6, skill=6, weighted_rmse=6)


@query(f"""WITH {SKILL}, m AS (SELECT cell, avg((climatology - observed) ** 2) AS a, avg((persistence - observed) ** 2) AS p, avg(observed ** 2) AS z FROM sk GROUP BY 1)
    SELECT 'climatology' AS model, count(*) AS n_blocks, round(avg((a < p)::INT), 6) AS win_rate FROM m UNION ALL SELECT 'zero', count(*), round(avg((z < p)::INT), 6) FROM m""")
def win_rate(spark, sf):
    long = _skill(spark, sf).withColumn("zero", F.lit(0.0)).unpivot(["cell", "observed"], ["climatology", "persistence", "zero"], "model", "predicted")
    return rounded(metrics.win_rate(long, "cell", "persistence"), win_rate=6)


@query(f"""WITH {SKILL}, m AS (SELECT month, sum(observed * valid) AS o, sum(climatology * valid) AS p FROM sk GROUP BY 1)
    SELECT count(*) AS n_months, round(avg(abs(p - o)), 2) AS mae, round(sqrt(avg((p - o) ** 2)), 2) AS rmse, round(avg(p - o), 2) AS bias, round(sum(p) / sum(o), 6) AS total_ratio FROM m""")
def monthly_area_error(spark, sf):
    return rounded(metrics.monthly_area_error(_skill(spark, sf), "observed", "climatology", "valid"), mae=2, rmse=2, bias=2, total_ratio=6)


@query(f"""WITH {SKILL} SELECT count(*) AS n, round(1 - avg((climatology - observed) ** 2) / avg((persistence - observed) ** 2), 6) AS skill,
    round(avg(CASE WHEN observed <> persistence THEN (sign(observed - persistence) = sign(climatology - persistence))::INT END), 6) AS sign_hits FROM sk""")
def change_skill(spark, sf):
    return rounded(metrics.change_skill(_skill(spark, sf), "observed", "climatology", "persistence"), skill=6, sign_hits=6)


@query(f"""WITH {SKILL}, d AS (SELECT cell, month, observed - climatology AS o, persistence - climatology AS p FROM sk), r AS (SELECT *, {RANKED.format(k='cell', x='o')} AS a, {RANKED.format(k='cell', x='p')} AS c FROM d),
    s AS (SELECT cell, count(DISTINCT month) AS m, count(DISTINCT round(o, 12)) AS k, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(c) < max(c) THEN corr(a, c) END AS r FROM r GROUP BY 1)
    SELECT round(avg(r) FILTER (WHERE m >= 4 AND k >= 3), 6) AS mean_spearman, count(r) FILTER (WHERE m >= 4 AND k >= 3) AS n_scored, count(*) AS n_cells, count(*) FILTER (WHERE m < 4) AS n_short,
        count(*) FILTER (WHERE m >= 4 AND k < 3) AS n_constant, count(*) FILTER (WHERE m >= 4 AND k >= 3 AND r IS NULL) AS n_undefined FROM s""")
def residual_correlation(spark, sf):
    return rounded(metrics.residual_correlation(_skill(spark, sf), "cell", "observed", "persistence", "climatology"), mean_spearman=6)


@query(f"""WITH {PANEL}, x AS (SELECT cover AS x, avg(cover) OVER (PARTITION BY month) AS xm, avg(cover) OVER (PARTITION BY cell) AS xr, (SELECT avg(cover) FROM panel) AS g FROM panel)
    SELECT count(*) AS n, round(sum((x - g) ** 2), 5) AS ss_total, round(sum((xm - g) ** 2), 5) AS ss_month, round(sum((xr - g) ** 2), 5) AS ss_region, round(sum((x - xm) ** 2), 5) AS ss_within_month, round(sum((x - xm - xr + g) ** 2), 5) AS ss_interaction FROM x""")
def variance_decomposition(spark, sf):
    out = metrics.variance_parts(b.panel_table(spark, sf), "cover", "cell")
    return rounded(out, **{c: 5 for c in out.columns if c != "n"})


@query(f"""WITH {PIXELS} SELECT coalesce(sensor, 'All') AS sensor, CASE WHEN grouping(model) = 1 THEN 'All' ELSE CAST(model AS VARCHAR) END AS model, count(*) AS n FROM pixels GROUP BY CUBE (sensor, model)""")
def crosstab_margins(spark, sf):
    return metrics.crosstab(b.pixels(spark, sf), "sensor", "model")


@query(f"WITH {PIXELS} SELECT model, rule, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6)::DOUBLE AS share FROM pixels GROUP BY 1, 2")
def crosstab_row_shares(spark, sf):
    return rounded(metrics.row_shares(b.pixels(spark, sf), "model", "rule"), share=6)


@query(f"""WITH {PANEL} SELECT cell, count(cover) AS n, round(avg(cover), 6) AS mean, round(stddev_samp(cover), 6) AS std, round(min(cover), 6) AS min, round(quantile_cont(cover, 0.25), 6) AS q25, round(median(cover), 6) AS median,
    round(quantile_cont(cover, 0.75), 6) AS q75, round(max(cover), 6) AS max FROM panel GROUP BY 1""")
def summary_stats(spark, sf):
    out = metrics.describe(b.panel(spark, sf), ["cell"], "cover")
    return rounded(out, **{c: 6 for c in out.columns if c not in ("cell", "n")})


@query(f"""WITH {PANEL}, t AS (SELECT * FROM (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7)) t(threshold))
    SELECT threshold, count(*) FILTER (WHERE cover >= threshold) AS n_present, round(count(*) FILTER (WHERE cover >= threshold) / count(*), 6) AS prevalence, round(coalesce(sum(CASE WHEN cover >= threshold THEN cover * valid END) / sum(cover * valid), 0), 6) AS area_share FROM panel CROSS JOIN t GROUP BY 1""")
def presence_inventory(spark, sf):
    return rounded(metrics.presence_table(b.panel(spark, sf), "cover", "valid", [0.3, 0.4, 0.5, 0.6, 0.7]), prevalence=6, area_share=6)


@query(f"""WITH {PANEL}, q AS (SELECT quantile_cont(rain, 1 / 3::DOUBLE) AS a, quantile_cont(rain, 2 / 3::DOUBLE) AS c FROM panel)
    SELECT CAST(1 + (rain > a)::INT + (rain > c)::INT AS INT) AS tertile, count(*) AS n, round(avg(cover), 6) AS mean_cover FROM panel, q GROUP BY 1""")
def quantile_tertiles(spark, sf):
    t = metrics.quantile_groups(b.panel_table(spark, sf), "rain")
    return rounded(t.groupBy("tertile").agg(F.count("*").alias("n"), F.avg("cover").alias("mean_cover")), mean_cover=6)


@query(f"""WITH {PIXELS}, {AGREE.format(k='sensor')}, m AS (SELECT sensor, round(same / n, 6) AS agreement, round(n_both / n_either, 6) AS jaccard FROM x), l AS (UNPIVOT m ON agreement, jaccard INTO NAME metric VALUE v)
    SELECT metric, max(v) FILTER (WHERE sensor = 'S1') AS "S1", max(v) FILTER (WHERE sensor = 'S2') AS "S2" FROM l GROUP BY 1""")
def scheme_unpivot_pivot(spark, sf):
    m = rounded(metrics.agreement(b.pixels(spark, sf), ["sensor"], "model", "rule", [0, 1, 2], 2).select("sensor", "agreement", "jaccard"), agreement=6, jaccard=6)
    return metrics.wide_to_schemes(m, [], "sensor", ["S1", "S2"], ["agreement", "jaccard"])


@query(f"""WITH {PIXELS}, {AGREE.format(k='sensor, month')}, s AS (SELECT sensor, month, n, same / n AS a, n_both / nullif(n_either, 0) AS j FROM x)
    SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(a * n) / sum(n), 6) AS a, round(sqrt(sum(j * j * n) / sum(n)), 6) AS j FROM s""")
def pooled_comparison(spark, sf):
    s = metrics.agreement(b.pixels(spark, sf), SCENE, "model", "rule", [0, 1, 2], 2).select("n", F.col("agreement").alias("a"), F.col("jaccard").alias("j"))
    return rounded(metrics.pooled(s, "n", ["a"], "j"), a=6, j=6)


@query(f"""WITH {PIXELS}, s AS (SELECT sensor, CAST((model = 2) AS INT) AS y, l_p AS p FROM (SELECT sensor, model, probability AS l_p FROM pixels WHERE probability IS NOT NULL)),
    r AS (SELECT *, {RANKED.format(k='sensor', x='p')} AS rk FROM s), a AS (SELECT sensor, sum(CASE WHEN y = 1 THEN rk END) AS sm, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, avg((y - p / 100) ** 2) AS brier FROM r GROUP BY 1)
    SELECT sensor, n_pos, n_neg, round((sm - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6)::DOUBLE AS auc, round(brier, 6) AS brier FROM a""")
def presence_ranking(spark, sf):
    p = b.pixels(spark, sf).filter("probability is not null").select("sensor", (F.col("model") == 2).cast("int").alias("y"), (F.col("probability") / 100).alias("p"))
    return rounded(metrics.rank_auc(p, ["sensor"], "y", "p"), auc=6, brier=6)


BOYCE = f"""{PANEL}, v AS (SELECT (cover >= 0.5)::INT AS t, rain / (SELECT max(rain) FROM panel) AS s FROM panel), w AS (SELECT CAST(i AS INT) AS bin, i * 0.1::DOUBLE AS low, i * 0.1::DOUBLE + 0.1 AS high FROM generate_series(0, 9) g(i)),
    bw AS (SELECT bin, low, high, count(t) AS n, avg(t) / (SELECT avg(t) FROM v) AS enrichment FROM w LEFT JOIN v ON s >= low AND (s < high OR (bin = 9 AND s <= high + 1e-12)) GROUP BY 1, 2, 3)"""


def _scores(spark, sf):
    p = b.panel_table(spark, sf)
    return p.join(F.broadcast(p.agg(F.max("rain").alias("_most")))).select((F.col("cover") >= 0.5).cast("int").alias("t"), (F.col("rain") / F.col("_most")).alias("s"))


@query(f"WITH {BOYCE} SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n, round(enrichment, 6) AS enrichment FROM bw")
def boyce_windows(spark, sf):
    return rounded(metrics.boyce_windows(_scores(spark, sf), "t", "s"), low=6, high=6, enrichment=6)


@query(f"""WITH {BOYCE}, k AS (SELECT 1 AS g, * FROM bw WHERE enrichment IS NOT NULL), r AS (SELECT {RANKED.format(k='g', x='low')} AS a, {RANKED.format(k='g', x='enrichment')} AS c FROM k)
    SELECT count(*) AS n, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(c) < max(c) THEN round(corr(a, c), 6) END AS boyce FROM r""")
def boyce_index(spark, sf):
    return rounded(metrics.boyce(_scores(spark, sf), "t", "s"), boyce=6)
