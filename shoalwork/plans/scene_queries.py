"""Queries over observations in time, catalogues, folds and regressions, each with its SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import catalog, components, folds, panel, stats, temporal
from . import bindings as b
from .bindings import LINES, OBS, PANEL, REGIONS
from .registry import query, rounded

DAILY = OBS + ", daily AS (SELECT point, day, avg(value) AS value, count(*) AS n, any_value(point) AS p FROM obs WHERE point IS NOT NULL GROUP BY 1, 2)"


def daily(spark, sf):
    return b.observations(spark, sf).groupBy("point", "day").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


@query(f"""WITH {DAILY}, w AS (SELECT point, day, count(value) OVER v AS n_obs, avg(value) OVER v AS m, stddev_samp(value) OVER v AS s FROM daily WINDOW v AS (PARTITION BY point ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
    SELECT point, day, n_obs, CASE WHEN n_obs >= 3 THEN round(m, 9) END AS mean, CASE WHEN n_obs >= 3 THEN round(s, 4) END AS std, CASE WHEN n_obs >= 3 AND abs(m) >= 1e-6 THEN round(s / abs(m), 4) END AS cv FROM w""")
def lookback_stats(spark, sf):
    out = temporal.lookback(daily(spark, sf).select("point", "day", "value"), ["point"], "day", "value", 7)
    return rounded(out.drop("value"), mean=9, std=4, cv=4)


@query(f"""WITH {DAILY}, w AS (SELECT point, day, count(value) OVER v AS n_obs, stddev_pop(value) OVER v AS s FROM daily WINDOW v AS (PARTITION BY point ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
    SELECT point, day, n_obs, CASE WHEN n_obs >= 3 THEN round(s, 4) END AS std FROM w""")
def lookback_stats_population(spark, sf):
    out = temporal.lookback(daily(spark, sf).select("point", "day", "value"), ["point"], "day", "value", 7, ddof=0)
    return rounded(out.select("point", "day", "n_obs", "std"), std=4)


@query(f"""WITH {DAILY} SELECT t.point, t.day AS target_end, c.day AS end_date, round(c.value, 6) AS value FROM daily t JOIN daily c ON c.point = t.point AND c.day < t.day AND t.day - c.day <= 7""")
def window_members(spark, sf):
    d = daily(spark, sf).select("point", F.col("day").alias("end_date"), "value")
    return rounded(temporal.members(d, d, ["point"], 7).select("point", "target_end", "end_date", "value"), value=6)


SCENES = "scenes AS (SELECT event_type, CAST(min(ts) AS DATE) AS s, CAST(min(ts) AS DATE) + 2 AS e, user_id % 97 AS scene FROM events WHERE user_id IS NOT NULL GROUP BY event_type, user_id % 97)"


@query(f"""WITH {OBS}, {SCENES}, j AS (SELECT o.obs, o.event_type, o.day, scene, s, abs(epoch(o.day) / 86400 - (epoch(s) + epoch(e)) / 2 / 86400) AS off FROM obs o JOIN scenes c ON c.event_type = o.event_type AND o.day >= s - 3 AND o.day <= e + 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type, obs ORDER BY off, s, scene) AS k FROM j)
    SELECT obs, event_type, day, scene, round(off, 2) AS days_off FROM r WHERE k = 1""")
def asof_nearest(spark, sf):
    o = b.observations(spark, sf)
    s = o.filter("point is not null").groupBy("event_type", (F.col("point") % 97).alias("scene")).agg(F.min("day").alias("s")).withColumn("e", F.date_add("s", 2))
    return rounded(temporal.nearest(o.select("obs", "event_type", "day"), s, ["event_type"], "obs", "day", "s", "e", "scene", 3), days_off=2)


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY ts DESC, obs DESC) AS k FROM obs)
    SELECT point, count(value) AS n_obs, round(stddev_samp(value), 4) AS std, CASE WHEN abs(avg(value)) >= 1e-6 THEN round(stddev_samp(value) / abs(avg(value)), 4) END AS cv, count(DISTINCT CASE WHEN event_type = 'purchase' THEN date_trunc('month', day) END) AS n_months_floating FROM obs GROUP BY 1""")
def point_stability(spark, sf):
    return rounded(temporal.point_stability(b.observations(spark, sf), "point", "day", "value", F.col("event_type") == "purchase"), std=4, cv=4)


@query(f"""WITH {DAILY}, r AS (SELECT point, day, value, row_number() OVER (PARTITION BY point ORDER BY day DESC) AS k FROM daily) SELECT point, day, round(value, 6) AS value FROM r WHERE k <= 5""")
def last_observations(spark, sf):
    return rounded(temporal.last_rows(daily(spark, sf).select("point", "day", "value"), ["point"], "day", 5), value=6)


@query(f"WITH {OBS} SELECT point, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.05), 6) AS p5 FROM obs GROUP BY 1")
def percentile_composites(spark, sf):
    o = b.observations(spark, sf)
    a, c = temporal.percentile_composite(o, ["point"], "value", 0.95, "p95"), temporal.percentile_composite(o, ["point"], "value", 0.05, "p5")
    return rounded(a.join(c, a["point"].eqNullSafe(c["point"])).drop(c["point"]), p95=6, p5=6)


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, round(median(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1, 2")
def median_composites(spark, sf):
    o = b.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return rounded(temporal.median_composite(o, ["day", "o_orderpriority"], ["o_totalprice"]), o_totalprice=4)


@query(f"""WITH {PANEL} SELECT cell, month, round(median(cover) OVER (PARTITION BY cell ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rolling_median FROM panel""")
def rolling_median(spark, sf):
    return rounded(temporal.rolling_median(b.panel(spark, sf), ["cell"], "month", "cover", 5).select("cell", "month", "rolling_median"), rolling_median=6)


@query(f"""WITH {PANEL} SELECT cell, month, CASE WHEN count(cover) OVER w >= 3 THEN round(median(cover) OVER w, 6) END AS rolling_median FROM panel WINDOW w AS (PARTITION BY cell ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_median_min_periods(spark, sf):
    return rounded(temporal.rolling_median(b.panel(spark, sf), ["cell"], "month", "cover", 5, 3).select("cell", "month", "rolling_median"), rolling_median=6)


@query(f"""WITH {DAILY} SELECT point, day, round(sum(value) OVER (PARTITION BY point ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 4) AS rain_30d FROM daily""")
def antecedent_sum(spark, sf):
    return rounded(panel.antecedent_sum(daily(spark, sf).select("point", "day", "value"), ["point"], "day", "value", 30, "rain_30d").drop("value"), rain_30d=4)


@query(f"""WITH {DAILY} SELECT point, round(sum(value), 4) AS total, round(max(value), 6) AS largest_day, count(*) FILTER (WHERE value >= 20) AS wet_days, count(*) FILTER (WHERE value >= 80) AS spikes,
    round(coalesce(sum(value) / nullif(count(*) FILTER (WHERE value >= 20), 0), 0), 9) AS intensity FROM daily GROUP BY 1""")
def rain_intensity(spark, sf):
    return rounded(temporal.wet_days(daily(spark, sf), ["point"], "value", 20.0, 80.0), total=4, largest_day=6, intensity=9)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def date_histogram(spark, sf):
    return b.observations(spark, sf).groupBy("day").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey""")
def pending_exports(spark, sf):
    li = b.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return catalog.pending(b.table(spark, sf, "orders").select("o_orderkey"), li.filter("l_returnflag = 'R'"), li.filter("l_quantity > 45"), keys=["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN q > 100 THEN 'completed' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def manifest_refresh(spark, sf):
    m = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    done = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q")).filter("q > 100").withColumn("status", F.lit("completed"))
    return catalog.refresh(m, done, "o_orderkey")


@query("""SELECT n_regionkey AS grp, count(DISTINCT c_custkey) AS n, 'customers' AS stage, 0 AS step FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
    UNION ALL SELECT n_regionkey, count(DISTINCT o_custkey), 'ordered', 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def pipeline_funnel(spark, sf):
    c = b.table(spark, sf, "customer").join(F.broadcast(b.regions(spark, sf)), F.col("c_nationkey") == F.col("cell")).select("c_custkey", F.col("region").alias("grp"))
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).join(c, "c_custkey")
    return catalog.funnel([("customers", c), ("ordered", o)], "c_custkey", "grp")


@query("""SELECT mode, count(*) AS n FROM (SELECT CASE WHEN s <= DATE '1998-06-30' AND e >= DATE '1998-03-01' THEN 1 ELSE 0 END AS overlap, CASE WHEN s BETWEEN DATE '1998-03-01' AND DATE '1998-06-30' THEN 1 ELSE 0 END AS start_within,
        CASE WHEN s >= DATE '1998-03-01' AND e <= DATE '1998-06-30' THEN 1 ELSE 0 END AS contained FROM (SELECT CAST(o_orderdate AS DATE) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate))
    UNPIVOT (hit FOR mode IN (overlap, start_within, contained)) WHERE hit = 1 GROUP BY 1""")
def date_window_modes(spark, sf):
    o, li = b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem")
    p = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("o_orderdate").cast("date").alias("s")).agg(F.max(F.col("l_shipdate").cast("date")).alias("e"))
    lo, hi = F.lit("1998-03-01").cast("date"), F.lit("1998-06-30").cast("date")
    modes = ["overlap", "start_within", "contained"]
    flags = p.select(*(fn.in_window(F.col("s"), F.col("e"), lo, hi, m).cast("int").alias(m) for m in modes))
    return flags.unpivot([], modes, "mode", "hit").filter("hit = 1").groupBy("mode").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT c_nationkey AS block, r AS repeat, md5(c_nationkey || ':' || r) AS h FROM customer, generate_series(0, 1) t(r)),
    f AS (SELECT block, repeat, CAST((row_number() OVER (PARTITION BY repeat ORDER BY h, block) - 1) % 5 AS INT) AS fold FROM k) SELECT c_custkey, CAST(repeat AS INT) AS repeat, fold FROM customer JOIN f ON c_nationkey = block""")
def spatial_block_folds(spark, sf):
    return folds.block_folds(b.table(spark, sf, "customer"), "c_nationkey", 5, 2).select("c_custkey", "repeat", "fold")


@query("""WITH s AS (SELECT s_suppkey, CAST(floor(s_acctbal / 1000) AS BIGINT) || '_' || CAST(floor(s_nationkey / 5) AS BIGINT) AS block FROM supplier), f AS (SELECT block, CAST((row_number() OVER (ORDER BY block) - 1) % 5 + 1 AS INT) AS fold FROM (SELECT DISTINCT block FROM s))
    SELECT s_suppkey, block, fold FROM s JOIN f USING (block)""")
def km_block_folds(spark, sf):
    s = b.table(spark, sf, "supplier").select("s_suppkey", F.concat_ws("_", F.floor(F.col("s_acctbal") / 1000).cast("string"), F.floor(F.col("s_nationkey") / 5).cast("string")).alias("block"))
    return folds.numbered_blocks(s, "block").select("s_suppkey", "block", "fold")


@query(f"""WITH {PANEL}, m AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM panel)) SELECT cell, p.month, CAST(CASE WHEN k <= 4 THEN 5 - k ELSE 0 END AS INT) AS fold FROM panel p JOIN m USING (month)""")
def temporal_folds(spark, sf):
    return folds.last_periods(b.panel(spark, sf), "month").select("cell", "month", "fold")


@query("""WITH t AS (SELECT year(o_orderdate) AS y, o_orderstatus AS c FROM orders), k AS (SELECT c, count(*) AS a FROM t GROUP BY 1), g AS (SELECT y, c, count(*) AS n FROM t GROUP BY 1, 2), d AS (SELECT DISTINCT y FROM t)
    SELECT d.y AS year, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_test, CAST((SELECT count(*) FROM t) - sum(coalesce(n, 0)) AS BIGINT) AS n_train, count(*) FILTER (WHERE a - coalesce(n, 0) > 0) AS n_classes, count(*) FILTER (WHERE a - coalesce(n, 0) > 0) > 1 AS usable
    FROM d CROSS JOIN k LEFT JOIN g ON g.y = d.y AND g.c = k.c GROUP BY 1""".replace("SELECT d.y AS year", "SELECT CAST(d.y AS INT) AS year"))
def leave_one_year_out(spark, sf):
    o = b.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return folds.leave_one_out(o, "year", "o_orderstatus")


@query("""WITH s AS (SELECT c_nationkey AS block, count(*) AS n FROM customer GROUP BY 1), w AS (SELECT block, coalesce(sum(n) OVER (ORDER BY md5(CAST(block AS VARCHAR)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT c_custkey, before < (SELECT count(*) FROM customer) * 0.2 AS held_out FROM customer JOIN w ON c_nationkey = block""")
def held_out_blocks(spark, sf):
    return folds.held_out_blocks(b.table(spark, sf, "customer"), "c_nationkey").select("c_custkey", "held_out")


REG = f"{PANEL}, z AS (SELECT cover AS y, rain / 1000 AS x1, driver * 10 AS x2, month, mi, cell, valid FROM panel WHERE driver IS NOT NULL)"


def regression_rows(spark, sf):
    return b.panel_table(spark, sf).filter("driver is not null").select(F.col("cover").alias("y"), (F.col("rain") / 1000).alias("x1"), (F.col("driver") * 10).alias("x2"), "month", "cell", "valid")


@query(f"""WITH {REG} SELECT 'one' AS term, round(regr_intercept(y, x1), 6) AS estimate, round(regr_r2(y, x1), 6) AS r2, count(*) AS n FROM z UNION ALL SELECT 'x1', round(regr_slope(y, x1), 6), round(regr_r2(y, x1), 6), count(*) FROM z""")
def ols_regression(spark, sf):
    return rounded(stats.ols(regression_rows(spark, sf), "y", ["x1"]).select("term", "estimate", "r2", "n"), estimate=6, r2=6)


@query(f"""WITH {REG}, r AS (SELECT corr(y, x1) AS a, corr(y, x2) AS c, corr(x1, x2) AS m FROM z), f AS (SELECT *, (a * a + c * c - 2 * a * c * m) / (1 - m * m) AS full_r2 FROM r)
    SELECT 'x1' AS term, round(full_r2 - c * c, 6) AS semi_partial_r2, round(full_r2, 6) AS full_r2 FROM f UNION ALL SELECT 'x2', round(full_r2 - a * a, 6), round(full_r2, 6) FROM f""")
def semi_partial_r2(spark, sf):
    return rounded(stats.drop_one_r2(regression_rows(spark, sf), "y", ["x1", "x2"]), semi_partial_r2=6, full_r2=6)


@query(f"""WITH {REG}, r AS (SELECT corr(y, x1) AS a, corr(y, x2) AS c, corr(x1, x2) AS m FROM z), f AS (SELECT *, (a * a + c * c - 2 * a * c * m) / (1 - m * m) AS full_r2 FROM r)
    SELECT 'g1' AS term, round((a * a + full_r2 - c * c) / 2, 6) AS shapley_r2, round(full_r2, 6) AS full_r2 FROM f UNION ALL SELECT 'g2', round((c * c + full_r2 - a * a) / 2, 6), round(full_r2, 6) FROM f""")
def shapley_r2(spark, sf):
    return rounded(stats.shapley_r2(regression_rows(spark, sf), "y", {"g1": ["x1"], "g2": ["x2"]}), shapley_r2=6, full_r2=6)


@query(f"""WITH {REG} SELECT 'x1' AS term, round(1 / (1 - corr(x1, x2) ** 2), 6) AS vif FROM z UNION ALL SELECT 'x2', round(1 / (1 - corr(x1, x2) ** 2), 6) FROM z""")
def vif(spark, sf):
    return rounded(stats.vif(regression_rows(spark, sf), ["x1", "x2"]), vif=6)


@query(f"""WITH {PANEL}, p AS (SELECT cell, month, 1 - cover AS p FROM panel), m AS (SELECT *, p * count(*) OVER (PARTITION BY cell) / count(*) OVER (PARTITION BY cell ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM p)
    SELECT cell, month, round(least(1.0, min(raw) OVER (PARTITION BY cell ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM m""")
def bh_fdr(spark, sf):
    p = b.panel(spark, sf).select("cell", "month", (1 - F.col("cover")).alias("p"))
    return rounded(stats.bh_fdr(p, "p", ["cell"]).select("cell", "month", "q"), q=6)


@query(f"""WITH {REG}, g AS (SELECT avg(y) AS m, count(*) AS n FROM z), s AS (SELECT mi, sum(y - m) AS s FROM z, g GROUP BY 1), own AS (SELECT sum((y - m) ** 2) AS v FROM z, g),
    c AS (SELECT sum(2 * (1 - (x.mi - w.mi) / 4.0) * x.s * w.s) AS v FROM s x JOIN s w ON x.mi - w.mi BETWEEN 1 AND 3)
    SELECT round(m, 6) AS estimate, round(sqrt((own.v + c.v) / (n::DOUBLE * (n - 1))), 6) AS std_error FROM g, own, c""")
def hac_mean(spark, sf):
    return rounded(stats.mean_test(regression_rows(spark, sf), "y", 3).select("estimate", "std_error"), estimate=6, std_error=6)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 100 + s_nationkey AS b FROM (SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey ) q JOIN orders ON q.l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM u UNION SELECT node, b FROM reach JOIN u ON other = a)
    SELECT CAST(node AS BIGINT) AS node, CAST(min(other) AS BIGINT) AS component FROM reach GROUP BY 1""")
def connected_components(spark, sf):
    li, o, c, s = (b.table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return components.connected_components(e.select(F.col("c_nationkey").alias("a"), (F.col("s_nationkey") + 100).alias("b")))


@query("""SELECT CAST(floor((s_acctbal / 100) / 0.1) * 100000 + floor((s_suppkey / 7.0) / 0.1) AS BIGINT) AS block, count(*) AS n FROM supplier GROUP BY 1""")
def spatial_blocks(spark, sf):
    s = b.table(spark, sf, "supplier")
    return s.groupBy(fn.block_id(F.col("s_acctbal") / 100, F.col("s_suppkey") / 7.0).alias("block")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, round(s_acctbal / 1000, 6) AS lon, round(s_nationkey / 10.0, 6)::DOUBLE AS lat FROM supplier""")
def json_point_parse(spark, sf):
    s = b.table(spark, sf, "supplier").select("s_suppkey", fn.point_json(F.col("s_acctbal") / 1000, F.col("s_nationkey") / 10.0).alias("geo"))
    lon, lat = fn.point_of_json(F.col("geo"))
    return rounded(s.select("s_suppkey", lon.alias("lon"), lat.alias("lat")), lon=6, lat=6)


RING = [(0.0, 0.0), (6000.0, 0.0), (6000.0, 15.0), (2000.0, 20.0)]


@query("""WITH p AS (SELECT s_suppkey, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
    SELECT s_suppkey, ((CASE WHEN y >= 0 AND y < 15 AND x < 6000 THEN 1 ELSE 0 END) + (CASE WHEN y >= 15 AND y < 20 AND x < 6000 + (y - 15) * (-4000 / 5.0) THEN 1 ELSE 0 END) + (CASE WHEN y >= 0 AND y < 20 AND x < 2000 + (y - 20) * (2000 / 20.0) THEN 1 ELSE 0 END)) % 2 = 1 AS inside FROM p""")
def inside_polygon(spark, sf):
    return b.table(spark, sf, "supplier").select("s_suppkey", fn.inside_ring(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), RING).alias("inside"))


@query("""WITH u AS (SELECT event_id, value - 50 AS u, event_id % 100 - 50 AS v FROM events WHERE value IS NOT NULL)
    SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round(degrees(atan2(u, v)) - 360 * floor(degrees(atan2(u, v)) / 360), 6) AS direction, round(u * sin(radians(60.0)) + v * cos(radians(60.0)), 6) AS along, round(u * cos(radians(60.0)) - v * sin(radians(60.0)), 6) AS across FROM u""")
def wind_components(spark, sf):
    e = b.table(spark, sf, "events").filter("value is not null")
    got = fn.wind(F.col("value") - 50, F.col("event_id") % 100 - 50, 60.0)
    return rounded(e.select("event_id", *(c.alias(n) for n, c in got.items())), speed=6, direction=6, along=6, across=6)


@query(f"""WITH {PANEL} SELECT cell, month, round(ln(greatest(least(cover, 1 - 1e-4), 1e-4) / (1 - greatest(least(cover, 1 - 1e-4), 1e-4))), 6) AS logit, round(ln(greatest(cover, 1e-4)), 6) AS log, round(greatest(least(cover, 1 - 1e-4), 1e-4), 6) AS back FROM panel""")
def response_transforms(spark, sf):
    c = F.col("cover")
    out = b.panel(spark, sf).select("cell", "month", fn.transform(c).alias("logit"), fn.transform(c, "log").alias("log"), fn.inverse_transform(fn.transform(c)).alias("back"))
    return rounded(out, logit=6, log=6, back=6)


@query("""SELECT c_custkey, lower(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
    CASE WHEN abs(floor(c_acctbal)) < 1024 THEN printf('%.0f B', floor(c_acctbal)) ELSE printf('%.2f KB', floor(c_acctbal) / 1024) END AS size, (c_mktsegment IS NULL OR trim(c_mktsegment) IN ('', 'nan', 'None')) AS blank FROM customer""")
def text_helpers(spark, sf):
    c = b.table(spark, sf, "customer")
    return c.select("c_custkey", fn.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"), fn.byte_text(fn.whole(F.col("c_acctbal"))).alias("size"), fn.is_blank(F.col("c_mktsegment")).alias("blank"))


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) SELECT k, c_custkey, CAST(place AS INT) AS place FROM c WHERE place > 1""")
def collisions(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    return catalog.collisions(c, ["k"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("k", "c_custkey", "place")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 8""")
def top_failures(spark, sf):
    return b.table(spark, sf, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select("o_orderkey", "o_totalprice")


@query(f"""WITH {PANEL}, a AS (SELECT DISTINCT month FROM panel WHERE cell < 12), c AS (SELECT DISTINCT month FROM panel WHERE cell >= 12), both_ AS (SELECT * FROM a INTERSECT SELECT * FROM c), only_a AS (SELECT * FROM a EXCEPT SELECT * FROM c)
    SELECT 'common' AS part, count(*) AS n FROM both_ UNION ALL SELECT 'first only', count(*) FROM only_a""")
def month_sets(spark, sf):
    p = b.panel_table(spark, sf)
    a, c = p.filter("cell < 12").select("month").distinct(), p.filter("cell >= 12").select("month").distinct()
    return a.intersect(c).agg(F.lit("common").alias("part"), F.count("*").alias("n")).unionByName(a.exceptAll(c).agg(F.lit("first only").alias("part"), F.count("*").alias("n")))


@query(f"""WITH {LINES}, d AS (SELECT day, median(l_extendedprice) AS v FROM lines GROUP BY 1), m AS (SELECT l_orderkey AS pixel, string_agg(DISTINCT l_shipdate::DATE::VARCHAR, ';') AS p FROM lineitem GROUP BY 1)
    SELECT count(DISTINCT l_shipdate::DATE) AS n_parts FROM lineitem""")
def cached_sources(spark, sf):
    m = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.col("l_shipdate").cast("date").cast("string")), ";").alias("paths"))
    return catalog.distinct_parts(m, "paths")


@query(f"""WITH {PANEL}, {REGIONS}, x AS (SELECT r.region, p.month, p.cover FROM panel p JOIN regions r USING (cell)) SELECT region, month, round(cover, 6) AS cover, round(max(cover) OVER (PARTITION BY region), 6) AS region_max, round(avg(cover) OVER (PARTITION BY region, month), 6) AS month_mean FROM x""")
def group_broadcast(spark, sf):
    x = b.panel(spark, sf).join(F.broadcast(b.regions(spark, sf)), "cell").select("region", "month", "cover")
    out = x.withColumns({"region_max": F.max("cover").over(Window.partitionBy("region")), "month_mean": F.avg("cover").over(Window.partitionBy("region", "month"))})
    return rounded(out, cover=6, region_max=6, month_mean=6)
