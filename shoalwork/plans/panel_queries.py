"""Queries over panels, series and coverage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import calendar, panel, zonal
from . import bindings as b
from .bindings import FULL, PANEL, REGIONS
from .registry import query, rounded

CELL = ["cell"]


@query(f"""WITH {PANEL}, grid AS (
        SELECT cell, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM panel GROUP BY cell),
    d AS (SELECT g.cell, g.month, p.cover, p.target, p.valid, CAST(year(g.month) * 12 + month(g.month) - 1 AS INT) AS mi FROM grid g LEFT JOIN panel p USING (cell, month))
    SELECT d.cell, d.month, round(d.cover, 6) AS cover, round(d.target, 2) AS target, round(d.valid, 2) AS valid, round(l.cover, 6) AS cover_lag1, d.valid IS NULL AS is_gap
    FROM d LEFT JOIN d l ON l.cell = d.cell AND l.mi = d.mi - 1""")
def monthly_area(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: pooled areas per cell and month on an unbroken calendar with the calendar lag."""
    d = calendar.densify(b.panel(spark, sf).select("cell", "month", "cover", "target", "valid"), CELL)
    d = calendar.calendar_lag(d, CELL, ["cover"]).withColumn("is_gap", F.col("valid").isNull())
    return rounded(d.select("cell", "month", "cover", "target", "valid", "cover_lag1", "is_gap"), cover=6, target=2, valid=2, cover_lag1=6)


@query(f"""WITH {PANEL} SELECT p.cell, p.month, round(l.cover, 6) AS cover_lag1, round(m.cover, 6) AS cover_lag2 FROM panel p
    LEFT JOIN panel l ON l.cell = p.cell AND l.mi = p.mi - 1 LEFT JOIN panel m ON m.cell = p.cell AND m.mi = p.mi - 2""")
def calendar_lag(spark, sf):
    d = calendar.calendar_lag(calendar.calendar_lag(b.panel(spark, sf), CELL, ["cover"]), CELL, ["cover"], 2)
    return rounded(d.select("cell", "month", "cover_lag1", "cover_lag2"), cover_lag1=6, cover_lag2=6)


@query(f"WITH {PANEL} SELECT cell, month, round(lag(cover) OVER (PARTITION BY cell ORDER BY month), 6) AS cover_prev1 FROM panel")
def positional_lag(spark, sf):
    return rounded(calendar.positional_lag(b.panel(spark, sf), CELL, ["cover"]).select("cell", "month", "cover_prev1"), cover_prev1=6)


@query(f"""WITH {PANEL}, l AS (SELECT cell, mi, lag(mi) OVER (PARTITION BY cell ORDER BY mi) AS b FROM panel)
    SELECT cell, count(*) AS n_rows, CAST(max(mi) - min(mi) + 1 AS INT) AS span_months, count(*) FILTER (WHERE b <> mi - 1) AS n_after_gap FROM l GROUP BY cell""")
def calendar_gaps(spark, sf):
    return calendar.gap_report(b.panel(spark, sf), CELL)


@query(f"""WITH {PANEL}, g AS (SELECT cell, month, mi - row_number() OVER (PARTITION BY cell ORDER BY mi) AS k FROM panel)
    SELECT cell, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months FROM g GROUP BY cell, k""")
def month_runs(spark, sf):
    return calendar.runs(b.panel(spark, sf), CELL)


@query(f"""WITH {PANEL}, grid AS (SELECT cell, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM panel GROUP BY cell),
    m AS (SELECT g.cell, g.month, year(g.month) * 12 + month(g.month) - 1 AS mi FROM grid g ANTI JOIN panel p ON p.cell = g.cell AND p.month = g.month),
    k AS (SELECT *, mi - row_number() OVER (PARTITION BY cell ORDER BY mi) AS k FROM m),
    s AS (SELECT cell, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months FROM k GROUP BY cell, k)
    SELECT *, CAST(row_number() OVER (PARTITION BY cell ORDER BY n_months DESC, first_month) AS INT) AS gap_rank FROM s""")
def gap_islands(spark, sf):
    return calendar.gap_spans(b.panel(spark, sf), CELL)


@query(f"""WITH {PANEL}, l AS (SELECT cell, month AS from_month, round(cover, 6) AS from_value, mi, lead(month) OVER w AS to_month, round(lead(cover) OVER w, 6) AS to_value, lead(mi) OVER w AS nmi
        FROM panel WINDOW w AS (PARTITION BY cell ORDER BY mi))
    SELECT cell, from_month, from_value, to_month, to_value FROM l WHERE nmi - mi > 1""")
def gap_bridges(spark, sf):
    return rounded(calendar.bridges(b.panel(spark, sf), CELL, "cover"), from_value=6, to_value=6)


@query(f"""WITH {PANEL}, l AS (SELECT cell, month, mi, lag(mi) OVER (PARTITION BY cell ORDER BY mi) AS bm FROM panel)
    SELECT cell, month, CAST(sum(CASE WHEN mi - bm > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY mi) AS INT) AS segment, (bm IS NULL OR mi - bm > 1) AS starts FROM l""")
def series_segments(spark, sf):
    return calendar.segments(b.panel(spark, sf), CELL).select("cell", "month", "segment", "starts")


@query(f"""WITH {PANEL}, grid AS (SELECT cell, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM panel GROUP BY cell)
    SELECT g.cell, g.month FROM grid g ANTI JOIN panel p ON p.cell = g.cell AND p.month = g.month""")
def unobserved_months(spark, sf):
    return calendar.missing_months(b.panel(spark, sf), CELL)


@query(f"""WITH {PANEL} SELECT p.cell, p.month, round(y.cover, 6) AS cover_year_ago, y.cover IS NOT NULL AS available FROM panel p LEFT JOIN panel y ON y.cell = p.cell AND y.mi = p.mi - 12""")
def seasonal_naive(spark, sf):
    return rounded(calendar.seasonal_naive(b.panel(spark, sf), CELL, "cover").select("cell", "month", "cover_year_ago", "available"), cover_year_ago=6)


@query("""WITH c AS (SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT event_type, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c GROUP BY 1)
    SELECT g.event_type, g.month, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, month)""")
def monthly_counts_zero_filled(spark, sf):
    return calendar.monthly_counts(b.table(spark, sf, "events").select("event_type", "ts"), ["event_type"], F.col("ts"))


@query(f"""WITH {PANEL}, m AS (SELECT DISTINCT mi FROM panel), l AS (SELECT max(mi) AS last, min(mi) AS first FROM m),
    plan AS (SELECT row_number() OVER (ORDER BY f) AS fold, last - (8 - f + 1) * 3 AS train_to, last - (8 - f + 1) * 3 + 1 AS test_from, last - (8 - f) * 3 AS test_to FROM l, generate_series(1, 8) t(f) WHERE last - (8 - f + 1) * 3 + 1 > first)
    SELECT CAST(fold AS INT) AS fold, CAST(train_to AS INT) AS train_to, CAST(test_from AS INT) AS test_from, CAST(test_to AS INT) AS test_to, count(*) FILTER (WHERE mi <= train_to) AS n_train,
        count(*) FILTER (WHERE mi >= test_from) AS n_test, (count(*) FILTER (WHERE mi <= train_to) >= 24 AND count(*) FILTER (WHERE mi >= test_from) > 0) AS used
    FROM plan JOIN m ON mi <= test_to GROUP BY 1, 2, 3, 4""")
def rolling_origin_folds(spark, sf):
    return calendar.rolling_origins(b.panel(spark, sf))


@query(f"""WITH {PANEL} SELECT DISTINCT month, round(sin(month(month) * 2 * pi() / 12), 9) AS sin1, round(cos(month(month) * 2 * pi() / 12), 9) AS cos1,
    round(sin(2 * month(month) * 2 * pi() / 12), 9) AS sin2, round(cos(2 * month(month) * 2 * pi() / 12), 9) AS cos2, mi, make_date(CAST(floor(mi / 12) AS INT), CAST(mi % 12 + 1 AS INT), 1) AS back FROM panel""")
def season_terms(spark, sf):
    m = b.panel(spark, sf).select("month").distinct()
    out = m.select("month", *(c.alias(n) for n, c in fn.season_terms(F.col("month")).items()), panel.mi().alias("mi")).withColumn("back", fn.month_of_index(F.col("mi")))
    return rounded(out, sin1=9, cos1=9, sin2=9, cos2=9)


@query(f"""WITH {PANEL}, most AS (SELECT cell, max(valid) AS a FROM panel GROUP BY cell), t AS (SELECT count(*) AS n_eligible, sum(a) AS area_eligible FROM most),
    m AS (SELECT month, count(DISTINCT cell) AS n_cells, sum(valid) AS area_seen FROM panel GROUP BY month),
    a AS (SELECT *, n_cells / n_eligible AS cell_fraction, area_seen / area_eligible AS area_fraction FROM m, t)
    SELECT month, n_cells, n_eligible, round(cell_fraction, 6) AS cell_fraction, round(area_fraction, 6) AS area_fraction, NOT (cell_fraction < 0.5 OR area_fraction < 0.4) AS kept,
        CASE WHEN cell_fraction < 0.5 AND area_fraction < 0.4 THEN 'few cells; small area' WHEN cell_fraction < 0.5 THEN 'few cells' WHEN area_fraction < 0.4 THEN 'small area' ELSE 'kept' END AS reason FROM a""")
def coverage_audit(spark, sf):
    a = panel.coverage_audit(b.panel_table(spark, sf), "cell", "valid", 0.5, 0.4)
    return rounded(a.select("month", "n_cells", "n_eligible", "cell_fraction", "area_fraction", "kept", "reason"), cell_fraction=6, area_fraction=6)


@query(f"""WITH {PANEL}, m AS (SELECT month, count(DISTINCT cell) / (SELECT count(DISTINCT cell) FROM panel) AS f FROM panel GROUP BY month)
    SELECT p.cell, p.month, round(p.cover, 6) AS cover FROM panel p JOIN m USING (month) WHERE f >= 0.5""")
def covered_months(spark, sf):
    p = b.panel_table(spark, sf)
    return rounded(panel.covered_months(p, panel.coverage_audit(p, "cell", "valid", 0.5)).select("cell", "month", "cover"), cover=6)


@query(f"""WITH {PANEL}, t AS (SELECT count(DISTINCT month) AS n_months FROM panel), s AS (SELECT cell, count(DISTINCT month) AS n_seen FROM panel GROUP BY cell)
    SELECT cell, n_seen, n_months, round(n_seen / n_months, 6) AS month_fraction, n_seen / n_months >= 0.5 AS steady FROM s, t""")
def fixed_cell_set(spark, sf):
    return rounded(panel.steady_cells(b.panel_table(spark, sf), "cell", 0.5), month_fraction=6)


@query(f"""WITH {PANEL} SELECT month, round(sum(target), 2) AS target, round(sum(valid), 2) AS valid, count(DISTINCT cell) AS n_cells, round(sum(target) / sum(valid), 6) AS cover,
    round(sum(driver * valid) / sum(CASE WHEN driver IS NOT NULL THEN valid END), 6) AS driver FROM panel GROUP BY month""")
def weighted_driver_mean(spark, sf):
    return rounded(panel.monthly_series(b.panel(spark, sf), ["month"], "target", "valid", ["driver"]), target=2, valid=2, cover=6, driver=6)


@query(f"""WITH {PANEL}, {REGIONS}, r AS (SELECT * FROM panel JOIN regions USING (cell)), a AS (SELECT region, sum(a) AS region_area FROM (SELECT region, cell, max(valid) AS a FROM r GROUP BY 1, 2) GROUP BY 1),
    z AS (SELECT region, count(*) AS region_cells FROM regions GROUP BY 1),
    s AS (SELECT region, month, sum(target) / sum(valid) AS cover, sum(driver * valid) / sum(CASE WHEN driver IS NOT NULL THEN valid END) AS driver, count(DISTINCT cell) AS n_cells, sum(valid) AS valid FROM r GROUP BY 1, 2),
    x AS (SELECT s.*, n_cells / region_cells AS cell_fraction, valid / region_area AS area_fraction FROM s JOIN a USING (region) JOIN z USING (region))
    SELECT region, month, n_cells, round(cell_fraction, 6) AS cell_fraction, round(area_fraction, 6) AS area_fraction, (cell_fraction >= 0.6 AND area_fraction >= 0.4) AS passes,
        CASE WHEN cell_fraction >= 0.6 AND area_fraction >= 0.4 THEN round(cover, 6) END AS cover, CASE WHEN cell_fraction >= 0.6 AND area_fraction >= 0.4 THEN round(driver, 6) END AS driver FROM x""")
def regional_panel(spark, sf):
    out = panel.regional_series(b.panel_table(spark, sf), b.regions(spark, sf), "cell", "target", "valid", ["driver"], 0.6, 0.4)
    return rounded(out.select("region", "month", "n_cells", "cell_fraction", "area_fraction", "passes", "cover", "driver"), cell_fraction=6, area_fraction=6, cover=6, driver=6)


@query(f"""WITH {b.PIXELS}, s AS (SELECT sensor, cell, month, CAST(count(*) FILTER (WHERE model = 2) AS DOUBLE) AS target, CAST(count(*) AS DOUBLE) AS valid FROM pixels GROUP BY 1, 2, 3)
    SELECT cell, month, round(avg(target), 6) AS target, round(avg(valid), 6) AS valid, count(*) AS n_rows, string_agg(DISTINCT sensor, '; ' ORDER BY sensor) AS sensor, round(avg(target) / avg(valid), 6) AS cover FROM s GROUP BY 1, 2""")
def ratio_of_means(spark, sf):
    s = b.pixels(spark, sf).groupBy("sensor", "cell", "month").agg(F.count_if(F.col("model") == 2).cast("double").alias("target"), F.count("*").cast("double").alias("valid"))
    return rounded(panel.reduce_duplicates(s, ["cell", "month"], "target", "valid", "sensor"), target=6, valid=6, cover=6)


def _by_sensor(spark, sf):
    p = b.pixels(spark, sf).groupBy("sensor", "cell", "month").agg(F.count_if(F.col("model") == 2).alias("t"), F.count("*").alias("v")).filter("v >= 8")
    p = p.select("sensor", "cell", "month", (F.col("t") / F.col("v")).alias("cover"))
    return p.filter("sensor = 'S2'").drop("sensor"), p.filter("sensor = 'S1'").drop("sensor")


BY_SENSOR = f"""{b.PIXELS}, bs AS (SELECT sensor, cell, month, count(*) FILTER (WHERE model = 2) / count(*) AS cover FROM pixels GROUP BY 1, 2, 3 HAVING count(*) >= 8),
    s2 AS (SELECT * FROM bs WHERE sensor = 'S2'), s1 AS (SELECT * FROM bs WHERE sensor = 'S1')"""


@query(f"""WITH {BY_SENSOR} SELECT cell, month, round(cover, 6) AS cover, false AS filled FROM s2
    UNION ALL SELECT s1.cell, s1.month, round(s1.cover, 6), true FROM s1 ANTI JOIN s2 ON s1.cell = s2.cell AND s1.month = s2.month""")
def gapfill_antijoin(spark, sf):
    return rounded(panel.fill_gaps(*_by_sensor(spark, sf), ["cell", "month"]), cover=6)


@query(f"WITH {BY_SENSOR} SELECT s2.cell, s2.month, round(s2.cover, 6) AS first_value, round(s1.cover, 6) AS second_value FROM s2 JOIN s1 USING (cell, month)")
def sensor_overlap(spark, sf):
    return rounded(panel.overlap(*_by_sensor(spark, sf), ["cell", "month"], "cover"), first_value=6, second_value=6)


CLIMATOLOGY = f"""{PANEL}, cut AS (SELECT min(mi) + CAST(floor(0.7 * (max(mi) - min(mi))) AS INT) AS c FROM panel),
    train AS (SELECT p.*, month(month) AS m FROM panel p, cut WHERE mi <= c), tst AS (SELECT p.*, month(month) AS m FROM panel p, cut WHERE mi > c),
    k2 AS (SELECT cell, m, avg(cover) AS v FROM train GROUP BY 1, 2 HAVING count(*) >= 2), k1 AS (SELECT cell, avg(cover) AS v FROM train GROUP BY 1),
    k0 AS (SELECT m, avg(cover) AS v FROM train GROUP BY 1), ka AS (SELECT avg(cover) AS v FROM train),
    clim AS (SELECT t.*, coalesce(k2.v, k1.v, k0.v, ka.v) AS climatology, CASE WHEN k2.v IS NOT NULL THEN 'cell_month' WHEN k1.v IS NOT NULL THEN 'cell' WHEN k0.v IS NOT NULL THEN 'month' ELSE 'global' END AS climatology_level
        FROM tst t LEFT JOIN k2 ON k2.cell = t.cell AND k2.m = t.m LEFT JOIN k1 ON k1.cell = t.cell LEFT JOIN k0 ON k0.m = t.m, ka)"""


def split_panel(spark, sf):
    """Training and later months of the panel, and the test rows with climatology and persistence."""
    p = b.panel_table(spark, sf)
    p = p.withColumn("mi", panel.mi())
    cut = F.broadcast(p.agg((F.min("mi") + F.floor(0.7 * (F.max("mi") - F.min("mi")))).alias("_cut")))
    both = p.join(cut)
    train, test = both.filter("mi <= _cut").drop("_cut"), both.filter("mi > _cut").drop("_cut")
    return train, test, panel.climatology(train, test, "cover")


@query(f"WITH {CLIMATOLOGY} SELECT cell, month, round(climatology, 6) AS climatology, climatology_level FROM clim")
def climatology_fallback(spark, sf):
    return rounded(split_panel(spark, sf)[2].select("cell", "month", "climatology", "climatology_level"), climatology=6)


@query(f"""WITH {PANEL} SELECT cell, month, round(cover - avg(cover) OVER (PARTITION BY cell) - avg(cover) OVER (PARTITION BY month) + (SELECT avg(cover) FROM panel), 6) + 0 AS demeaned FROM panel""")
def two_way_demean(spark, sf):
    d = panel.two_way_demean(b.panel_table(spark, sf), "cover", ["cell", "month"])
    return d.select("cell", "month", (F.round("demeaned", 6) + 0).alias("demeaned"))


@query(f"WITH {PANEL}, s AS (SELECT avg(cover) AS m, stddev_samp(cover) AS sd, avg(rain) AS rm, stddev_samp(rain) AS rsd FROM panel) SELECT cell, month, round((cover - m) / sd, 5) + 0 AS cover_z, round((rain - rm) / rsd, 5) + 0 AS rain_z FROM panel, s")
def zscores(spark, sf):
    z = panel.zscore(b.panel_table(spark, sf).select("cell", "month", "cover", "rain"), ["cover", "rain"])
    return z.select("cell", "month", *((F.round(c, 5) + 0).alias(c) for c in ("cover_z", "rain_z")))


@query(f"WITH {FULL} SELECT CASE WHEN n_pixels >= 20 THEN 'kept' ELSE 'few pixels' END AS outcome, count(*) AS n FROM full_panel GROUP BY 1")
def validity_filter(spark, sf):
    return panel.validity_report(b.full_panel(spark, sf), "n_pixels", 20)


@query(f"""WITH {PANEL}, a AS (SELECT cell, month, rain FROM panel WHERE cover IS NOT NULL), e AS (SELECT cell, month, driver, rain * 2 AS rain FROM full_panel)
    SELECT cell, month, round(coalesce(a.rain, e.rain), 2) AS rain, round(driver, 6) AS driver FROM a FULL JOIN e USING (cell, month)""")
def covariate_merge(spark, sf):
    extra = b.full_panel(spark, sf).select("cell", "month", "driver", (F.col("rain") * 2).alias("rain"))
    return rounded(panel.merge_tables(b.panel(spark, sf).select("cell", "month", "rain"), extra, ["cell", "month"]), rain=2, driver=6)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rechecked' ELSE o_orderstatus END AS status FROM orders""")
def manifest_upsert(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return panel.upsert(o, o.filter("status = 'P'").withColumn("status", F.lit("rechecked")), ["o_orderkey"])


@query(f"""WITH {FULL} SELECT cell, month, round(rain, 2) AS rain FROM panel UNION ALL
    SELECT f.cell, f.month, round(f.rain, 2) FROM full_panel f ANTI JOIN panel p ON p.cell = f.cell AND p.month = f.month""".replace(FULL, PANEL))
def append_months(spark, sf):
    return rounded(panel.append_missing(b.panel(spark, sf), b.full_panel(spark, sf), ["cell", "month"]).select("cell", "month", "rain"), rain=2)


LATTICE = "lattice AS (SELECT n_nationkey AS cell, n_nationkey // 5 AS ix, n_nationkey % 5 AS iy FROM nation)"
EDGES = LATTICE + ", edges AS (SELECT a.cell, b.cell AS neighbor FROM lattice a JOIN lattice b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND a.cell <> b.cell)"


def lattice(spark, sf):
    return b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("cell"), F.floor(F.col("n_nationkey") / 5).alias("ix"), F.pmod("n_nationkey", F.lit(5)).cast("long").alias("iy"))


@query(f"WITH {EDGES} SELECT cell, neighbor FROM edges")
def grid_neighbours(spark, sf):
    return zonal.neighbours(lattice(spark, sf))


@query(f"""WITH {PANEL}, {EDGES}, a AS (SELECT e.cell, p.month, avg(p.cover) AS v FROM edges e JOIN panel p ON p.cell = e.neighbor GROUP BY 1, 2)
    SELECT p.cell, p.month, round(a.v, 6) AS cover_around_lag1 FROM panel p LEFT JOIN a ON a.cell = p.cell AND a.month + INTERVAL 1 MONTH = p.month""")
def neighbour_lag(spark, sf):
    out = zonal.neighbour_lag(b.panel_table(spark, sf), zonal.neighbours(lattice(spark, sf)), "cover")
    return rounded(out.select("cell", "month", "cover_around_lag1"), cover_around_lag1=6)


@query(f"""WITH {LATTICE}, sides AS (SELECT cell, dx, dy, ix + dx AS nx, iy + dy AS ny FROM lattice, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dx, dy))
    SELECT cell, dx, dy FROM sides ANTI JOIN lattice ON nx = ix AND ny = iy""")
def mask_outline(spark, sf):
    return zonal.outline(lattice(spark, sf))


@query(f"""WITH {PANEL}, {EDGES}, m AS (SELECT cell, avg(cover) AS v FROM panel GROUP BY 1), d AS (SELECT cell, v - (SELECT avg(v) FROM m) AS d FROM m)
    SELECT (SELECT count(*) FROM d) AS n, count(*) AS n_edges, round((SELECT count(*) FROM d) / count(*) * sum(x.d * y.d) / (SELECT sum(d * d) FROM d), 6) AS moran FROM edges e JOIN d x ON x.cell = e.cell JOIN d y ON y.cell = e.neighbor""")
def morans_i(spark, sf):
    v = b.panel_table(spark, sf).groupBy("cell").agg(F.avg("cover").alias("v"))
    return rounded(zonal.moran(v, zonal.neighbours(lattice(spark, sf)), "v"), moran=6)


@query(f"""WITH {LATTICE}, p AS (SELECT l.*, n_regionkey AS part FROM lattice l JOIN nation ON cell = n_nationkey)
    SELECT a.part AS a, q.part AS b, count(*) AS n_edges FROM p a JOIN p q ON abs(a.ix - q.ix) + abs(a.iy - q.iy) = 1 AND a.part < q.part GROUP BY 1, 2""")
def region_adjacency(spark, sf):
    cells = lattice(spark, sf).join(b.regions(spark, sf).withColumnRenamed("region", "part"), "cell")
    return zonal.adjacency(cells, "part")


@query(f"""WITH RECURSIVE {LATTICE}, p AS (SELECT l.*, n_regionkey AS part FROM lattice l JOIN nation ON cell = n_nationkey),
    e AS (SELECT a.cell AS a, q.cell AS b FROM p a JOIN p q ON abs(a.ix - q.ix) <= 1 AND abs(a.iy - q.iy) <= 1 AND a.part = q.part),
    reach AS (SELECT a AS cell, b AS other FROM e UNION SELECT reach.cell, e.b FROM reach JOIN e ON reach.other = e.a)
    SELECT p.cell, p.part, least(p.cell, (SELECT min(other) FROM reach r WHERE r.cell = p.cell)) AS patch FROM p""")
def grid_patches(spark, sf):
    cells = lattice(spark, sf).join(b.regions(spark, sf).withColumnRenamed("region", "part"), "cell").withColumn("cell", F.col("cell").cast("long"))
    return zonal.patches(cells, "part").select(F.col("cell").cast("int").alias("cell"), "part", F.col("patch").cast("int").alias("patch"))


@query("""SELECT CAST((x - 2) * 4 + (y - 1) AS BIGINT) AS cell, CAST(x AS BIGINT) AS ix, CAST(y AS BIGINT) AS iy, CAST((x + 0.5) * 500 AS DOUBLE) AS x, CAST((y + 0.5) * 500 AS DOUBLE) AS y FROM generate_series(2, 5) a(x), generate_series(1, 4) c(y)""")
def grid_builder(spark, sf):
    return zonal.grid(spark, 1200.0, 700.0, 3000.0, 2500.0, 500.0)
