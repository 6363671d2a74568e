"""Queries over regions, geometry, provenance and skill tables, each with its SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import catalog, folds, metrics, panel, polygons, regions, rules, temporal, texture, zonal
from . import bindings as b
from .bindings import OBS, PANEL, PIXELS, REGIONS
from .panel_queries import lattice
from .pixel_queries import SKILL, _skill
from .registry import query, rounded


@query("""WITH s AS (SELECT s_suppkey, s_nationkey * 1.0 AS r, s_acctbal / 10000 AS o FROM supplier)
    SELECT s_suppkey, CASE WHEN r <= 4 THEN 'river' WHEN o <= 0.2 THEN 'sheltered' WHEN o >= 0.7 THEN 'exposed' ELSE 'open' END AS setting FROM s""")
def setting_classes(spark, sf):
    label, _ = regions.setting_class(F.col("s_nationkey") * 1.0, F.col("s_acctbal") / 10000, 4.0, 0.2, 0.7)
    return b.table(spark, sf, "supplier").select("s_suppkey", label.alias("setting"))


@query("""WITH s AS (SELECT s_suppkey, s_acctbal - 5000 AS dx, s_nationkey - 12 AS dy FROM supplier), t AS (SELECT s_suppkey, (CASE WHEN dy > 3.75 THEN 'N' WHEN dy < -3.75 THEN 'S' ELSE '' END) || (CASE WHEN dx > 1500 THEN 'E' WHEN dx < -1500 THEN 'W' ELSE '' END) AS t FROM s)
    SELECT s_suppkey, CASE WHEN t = '' THEN 'central' ELSE t END AS tag FROM t""")
def compass_tags(spark, sf):
    return b.table(spark, sf, "supplier").select("s_suppkey", regions.compass_tag(F.col("s_acctbal") - 5000, F.col("s_nationkey") - 12, 10000.0, 25.0).alias("tag"))


@query()
def build_regions(spark, sf):
    cells = lattice(spark, sf).join(b.regions(spark, sf).withColumnRenamed("region", "zone"), "cell").withColumn("cell", F.col("cell").cast("long")).withColumn("feature", F.col("ix") * 1.0).withColumn("area", F.lit(25.0))
    return regions.build_regions(cells, "zone", ["feature"], "area", 3, 50.0)


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey // 5 - 1.0 AS lat0 FROM nation), q AS (SELECT k, sin(radians(lat0)) AS s0, sin(radians(lat0 + 1)) AS s1, 0.0818191908426215 AS e FROM n)
    SELECT k, round(((s1 / (1 - e * e * s1 * s1) + ln((1 + e * s1) / (1 - e * s1)) / (2 * e)) - (s0 / (1 - e * e * s0 * s0) + ln((1 + e * s0) / (1 - e * s0)) / (2 * e))) * (6356752.314245179 * 6356752.314245179 / 2 * radians(0.5)) / 10000, 1) AS ha FROM q""")
def geodesic_areas(spark, sf):
    low = F.floor(F.col("n_nationkey") / 5) - 1.0
    return rounded(b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), fn.geodesic_band_ha(low, low + 1, 0.5).alias("ha")), ha=1)


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_nationkey * 1.0 AS y FROM supplier) SELECT s_suppkey, round(sqrt(power(x - greatest(0.0, least(1.0, x / 8)) * 8, 2) + power(y, 2)), 6) AS distance FROM p""")
def distance_to_line(spark, sf):
    return rounded(b.table(spark, sf, "supplier").select("s_suppkey", fn.distance_to_ring(F.col("s_acctbal") / 1000, F.col("s_nationkey") * 1.0, [(0.0, 0.0), (8.0, 0.0)]).alias("distance")), distance=6)


def raster(spark, sf):
    """Suppliers and parts as a small raster: row by size, column by brand and type counts."""
    return b.table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("row"), (F.col("p_partkey") % 40).alias("col")).agg(F.avg("p_retailprice").alias("value"))


@query("""WITH r AS (SELECT p_size::BIGINT AS row, p_partkey % 40 AS col, avg(p_retailprice) AS value FROM part GROUP BY 1, 2)
    SELECT a.row, a.col, round(median(c.value), 6) AS value_focal FROM r a JOIN r c ON abs(a.row - c.row) <= 2 AND abs(a.col - c.col) <= 2 GROUP BY 1, 2""")
def focal_medians(spark, sf):
    return rounded(zonal.focal_median(raster(spark, sf), "value"), value_focal=6)


@query("""WITH r AS (SELECT p_size::BIGINT AS row, p_partkey % 40 AS col, (avg(p_retailprice) > 1400)::INT AS code FROM part GROUP BY 1, 2),
    d AS (SELECT a.row, a.col, min(sqrt((a.row - c.row) ** 2 + (a.col - c.col) ** 2)) AS d FROM r a LEFT JOIN r c ON c.code = 1 GROUP BY 1, 2)
    SELECT row, col, round(d, 6) AS distance FROM d""")
def distance_fields(spark, sf):
    r = raster(spark, sf).withColumn("code", (F.col("value") > 1400).cast("int"))
    return rounded(texture.distance_to_class(r, "code", 1), distance=6)


ORDER_RASTER = """o AS (SELECT l_orderkey AS cell, l_orderkey // 128 AS row, l_orderkey % 128 AS col, avg(l_quantity) AS q FROM lineitem GROUP BY 1)"""


def order_raster(spark, sf):
    """Orders as a raster of 128 columns that grows by rows with the table, with the mean quantity of their lines. Orders without lines are gaps."""
    key = F.col("l_orderkey")
    return b.table(spark, sf, "lineitem").groupBy(key.alias("cell")).agg(F.avg("l_quantity").alias("q")).withColumns({"row": F.floor(F.col("cell") / 128), "col": F.col("cell") % 128})


@query(f"""WITH {ORDER_RASTER} SELECT a.row, a.col, round(min(sqrt((a.row - c.row) ** 2 + (a.col - c.col) ** 2)), 6) AS distance FROM o a LEFT JOIN (SELECT * FROM o WHERE q > 42) c ON true GROUP BY 1, 2""")
def order_distances(spark, sf):
    r = order_raster(spark, sf).withColumn("code", (F.col("q") > 42).cast("int"))
    return rounded(texture.distance_to_class(r, "code", 1), distance=6)


@query(f"""WITH RECURSIVE {ORDER_RASTER}, m AS (SELECT cell, row AS y, col AS x FROM o WHERE q > 28),
    near AS (SELECT a.cell AS a, c.cell AS c FROM m a JOIN m c ON (a.y = c.y AND c.x IN (a.x - 1, a.x + 1)) OR (a.x = c.x AND c.y IN (a.y - 1, a.y + 1))),
    reach AS (SELECT cell AS a, cell AS c FROM m UNION SELECT r.a, n.c FROM reach r JOIN near n ON n.a = r.c), p AS (SELECT a AS cell, min(c) AS polygon FROM reach GROUP BY 1),
    own AS (SELECT polygon, count(*) AS n FROM p GROUP BY 1), pairs AS (SELECT polygon, count(*) / 2 AS e FROM near JOIN p ON cell = near.a GROUP BY 1),
    squares AS (SELECT polygon, count(*) AS s FROM m a JOIN p USING (cell) WHERE EXISTS (SELECT 1 FROM m WHERE y = a.y AND x = a.x + 1) AND EXISTS (SELECT 1 FROM m WHERE y = a.y + 1 AND x = a.x) AND EXISTS (SELECT 1 FROM m WHERE y = a.y + 1 AND x = a.x + 1) GROUP BY 1)
    SELECT polygon, CAST(n AS DOUBLE) AS area, CAST(4 * n - 2 * coalesce(e, 0) AS BIGINT) AS length, CAST(1 - (n - coalesce(e, 0) + coalesce(s, 0)) AS BIGINT) AS n_holes FROM own LEFT JOIN pairs USING (polygon) LEFT JOIN squares USING (polygon)""")
def mask_polygons(spark, sf):
    mask = order_raster(spark, sf).filter("q > 28").select("cell", F.col("col").alias("ix"), F.col("row").alias("iy"), F.lit(1).alias("label"))
    return polygons.polygons(mask, "label").select("polygon", "area", F.col("length").cast("long").alias("length"), F.col("n_holes").cast("long").alias("n_holes"))


@query("""WITH l AS (SELECT p_size::BIGINT AS row, p_partkey % 40 AS col, greatest(0, least(31, CAST(trunc((avg(p_retailprice) - 900) / 1100 * 32) AS INT))) AS v FROM part GROUP BY 1, 2), s AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) t(dr, dc)),
    pairs AS (SELECT a.row, a.col, dr, dc, least(a.v, q.v) AS lo, greatest(a.v, q.v) AS hi FROM l a CROSS JOIN s JOIN l q ON q.row = a.row + dr AND q.col = a.col + dc),
    w AS (SELECT c.row, c.col, lo, hi FROM l c JOIN pairs p ON p.row >= c.row - 2 AND p.row + dr <= c.row + 2 AND p.col BETWEEN c.col - 2 AND c.col + 2 AND p.col + dc BETWEEN c.col - 2 AND c.col + 2),
    g AS (SELECT row, col, lo, hi, count(*) AS k FROM w GROUP BY 1, 2, 3, 4), n AS (SELECT *, sum(k) OVER (PARTITION BY row, col) AS n FROM g),
    t AS (SELECT row, col, sum(k / n / (1 + (hi - lo) ** 2)) AS idm, sum(-k / n * ln(k / n / CASE WHEN lo = hi THEN 1 ELSE 2 END)) AS entropy, sum(k / n * (hi - lo) ** 2) AS contrast FROM n GROUP BY 1, 2)
    SELECT l.row, l.col, round(idm, 6) AS idm, round(entropy, 6) AS entropy, round(contrast, 6) AS contrast FROM l LEFT JOIN t ON t.row = l.row AND t.col = l.col""")
def textures(spark, sf):
    return rounded(texture.texture(raster(spark, sf), "value", 900.0, 2000.0, tile=16), idm=6, entropy=6, contrast=6)


@query(f"""WITH {PIXELS}, o AS (SELECT pixel, layer, model, rule, row_number() OVER (PARTITION BY pixel ORDER BY layer DESC, model, rule) AS k FROM pixels), l AS (SELECT pixel, model AS lr, rule AS rl FROM o WHERE k = 1)
    SELECT o_orderkey AS pixel, coalesce(lr, 255) AS lr, coalesce(rl, 255) AS rl, (lr IS NOT NULL AND rl IS NOT NULL) AS common_valid FROM orders LEFT JOIN l ON o_orderkey = pixel""")
def map_samples(spark, sf):
    last = catalog.winners(b.pixels(spark, sf), ["pixel"], [F.desc("layer"), F.asc("model"), F.asc("rule")]).select("pixel", F.col("model").alias("lr"), F.col("rule").alias("rl"))
    pts = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pixel"))
    a = temporal.sample(pts, last, ["pixel"], "lr").withColumnRenamed("sampled", "lr")
    return temporal.sample(a, last, ["pixel"], "rl").withColumnRenamed("sampled", "rl").withColumn("common_valid", (F.col("lr") != 255) & (F.col("rl") != 255))


@query(f"""WITH {SKILL}, {REGIONS}, r AS (SELECT region, s.* FROM sk s JOIN regions USING (cell)), g AS (SELECT region, sqrt(avg((climatology - observed) ** 2)) AS c, sqrt(avg((persistence - observed) ** 2)) AS p FROM r GROUP BY 1)
    SELECT 'pooled' AS grain, round(sqrt(avg((climatology - observed) ** 2)), 6) AS climatology, round(sqrt(avg((persistence - observed) ** 2)), 6) AS persistence FROM r
    UNION ALL SELECT 'region macro', round(avg(c), 6), round(avg(p), 6) FROM g
    UNION ALL SELECT 'area weighted', round(sqrt(sum(valid * (climatology - observed) ** 2) / sum(valid)), 6), round(sqrt(sum(valid * (persistence - observed) ** 2) / sum(valid)), 6) FROM r""")
def skill_table(spark, sf):
    r = _skill(spark, sf).join(F.broadcast(b.regions(spark, sf)), "cell")
    rm = lambda m, w=None: metrics.errors("observed", m, w)["rmse"].alias(m)
    pooled = r.agg(rm("climatology"), rm("persistence")).withColumn("grain", F.lit("pooled"))
    macro = r.groupBy("region").agg(rm("climatology"), rm("persistence")).agg(F.avg("climatology").alias("climatology"), F.avg("persistence").alias("persistence")).withColumn("grain", F.lit("region macro"))
    area = r.agg(rm("climatology", "valid"), rm("persistence", "valid")).withColumn("grain", F.lit("area weighted"))
    return rounded(pooled.unionByName(macro).unionByName(area), climatology=6, persistence=6)


@query(f"""WITH {PIXELS}, s AS (SELECT sensor, month, avg((model = rule)::INT) AS a, avg((model = 2)::INT) AS t FROM pixels GROUP BY 1, 2)
    SELECT sensor, count(*) AS n_scenes, round(avg(a), 6) AS mean_agreement, round(median(a), 6) AS median_agreement, round(stddev_samp(a), 6) AS std_agreement, round(max(t) - min(t), 6) AS target_range FROM s GROUP BY 1""")
def pooled_sensor_summary(spark, sf):
    s = b.pixels(spark, sf).groupBy("sensor", "month").agg(F.avg((F.col("model") == F.col("rule")).cast("int")).alias("a"), F.avg((F.col("model") == 2).cast("int")).alias("t"))
    out = s.groupBy("sensor").agg(F.count("*").alias("n_scenes"), F.avg("a").alias("mean_agreement"), F.median("a").alias("median_agreement"), F.stddev_samp("a").alias("std_agreement"), (F.max("t") - F.min("t")).alias("target_range"))
    return rounded(out, mean_agreement=6, median_agreement=6, std_agreement=6, target_range=6)


@query(f"""WITH {PIXELS}, s AS (SELECT sensor, month, avg((model = rule)::INT) AS a FROM pixels GROUP BY 1, 2) SELECT month, count(*) AS n, round(avg(a), 6) AS mean_agreement FROM s GROUP BY 1""")
def monthly_comparison(spark, sf):
    s = b.pixels(spark, sf).groupBy("sensor", "month").agg(F.avg((F.col("model") == F.col("rule")).cast("int")).alias("a"))
    return rounded(s.groupBy("month").agg(F.count("*").alias("n"), F.avg("a").alias("mean_agreement")), mean_agreement=6)


@query(f"""WITH {PANEL} SELECT cell, count(*) AS n, count(*) FILTER (WHERE abs(cover - target / valid) > 1e-9) AS n_bad, count(*) - count(DISTINCT month) AS n_repeated FROM panel GROUP BY 1""")
def provenance_audit(spark, sf):
    p = b.panel(spark, sf)
    bad = rules.ratio_violations(p, "cover", "target", "valid").groupBy("cell").agg(F.count("*").alias("_b"))
    out = p.groupBy("cell").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("month")).alias("n_repeated")).join(bad, "cell", "left")
    return out.select("cell", "n", F.coalesce("_b", F.lit(0)).alias("n_bad"), "n_repeated")


@query(f"""WITH {PANEL} SELECT cell, round(min(rain), 2) AS rain_min FROM panel GROUP BY 1""")
def static_cell_table(spark, sf):
    p = b.panel(spark, sf).withColumn("rain_min", F.min("rain").over(Window.partitionBy("cell")))
    return rounded(panel.static_table(p, "cell", ["rain_min", "rain"]), rain_min=2)


@query(f"""WITH {PANEL}, {REGIONS}, e AS (SELECT region, month, sum(driver * valid) / sum(CASE WHEN driver IS NOT NULL THEN valid END) AS driver FROM panel JOIN regions USING (cell) GROUP BY 1, 2), m AS (SELECT DISTINCT month FROM panel), r AS (SELECT DISTINCT region FROM regions)
    SELECT region, month, round(driver, 6) AS driver FROM m CROSS JOIN r LEFT JOIN e USING (region, month)""")
def regional_environment(spark, sf):
    p = b.panel(spark, sf)
    e = p.join(F.broadcast(b.regions(spark, sf)), "cell").groupBy("region", "month").agg(fn.weighted_mean(F.col("driver"), F.col("valid")).alias("driver"))
    grid = p.select("month").distinct().join(F.broadcast(b.regions(spark, sf).agg(F.collect_set("region").alias("_r")))).select("month", F.explode("_r").alias("region"))
    return rounded(grid.join(e, ["region", "month"], "left").select("region", "month", "driver"), driver=6)


@query(f"""WITH {OBS}, s AS (SELECT point, ts, obs, CASE WHEN ts - lag(ts) OVER (PARTITION BY point ORDER BY ts, obs) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM obs), g AS (SELECT point, ts, sum(b) OVER (PARTITION BY point ORDER BY ts, obs) AS k FROM s)
    SELECT point, count(DISTINCT k) AS n_sessions, max(n) AS longest FROM (SELECT point, k, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def session_gaps(spark, sf):
    w = Window.partitionBy("point").orderBy("ts", "obs")
    o = b.observations(spark, sf).withColumn("_b", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 12 hours"), 0).otherwise(1)).withColumn("k", F.sum("_b").over(w))
    return o.groupBy("point", "k").agg(F.count("*").alias("n")).groupBy("point").agg(F.countDistinct("k").alias("n_sessions"), F.max("n").alias("longest"))


@query("""WITH o AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) SELECT o_orderkey FROM o ORDER BY h, o_orderkey LIMIT 100""")
def hashed_subset(spark, sf):
    """A sampling operator: the first hundred rows in the order of a hash."""
    o = b.table(spark, sf, "orders").select("o_orderkey")
    return o.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(100)


@query("""WITH o AS (SELECT o_orderstatus AS arm, o_orderpriority AS model, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT a.model, round(a.v, 2) AS baseline, round(c.v, 2) AS corrected, round(c.v - a.v, 2) AS delta FROM o a JOIN o c USING (model) WHERE a.arm = 'F' AND c.arm = 'O'""")
def paired_deltas(spark, sf):
    o = b.table(spark, sf, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("v"))
    pair = panel.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["model"], "v")
    return rounded(pair.select("model", F.col("first_value").alias("baseline"), F.col("second_value").alias("corrected"), (F.col("second_value") - F.col("first_value")).alias("delta")), baseline=2, corrected=2, delta=2)


@query("""WITH r AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS m, stddev_samp(o_totalprice) / 1000 AS s FROM orders GROUP BY 1), b AS (SELECT max(m) AS bm, arg_max(s, m) AS bs FROM r), t AS (SELECT model, round(m, 4) AS m, m >= bm - bs AS tied FROM r, b)
    SELECT model, m, tied, model = (SELECT min(model) FROM t WHERE tied) AS chosen FROM t""")
def tie_aware_selection(spark, sf):
    r = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("m"), (F.stddev_samp("o_totalprice") / 1000).alias("s"))
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return rounded(folds.steadiest(r, "model", "m", "s", order).select("model", "m", "tied", "chosen"), m=4)
