"""Queries over the smaller operators: masks, names, streams run to their end, layered tables, polygons and training tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import calendar, panel, rules, temporal, training, zonal
from ..sources import files as sources
from ..streaming import monitor
from . import bindings as b
from .bindings import LINES, OBS, PANEL
from .registry import query, rounded
from .storage import delete, materialize, table_path


@query("""SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) + CAST(floor((event_id % 9) / 2) AS INT) AS middle, CASE WHEN value IS NOT NULL AND value <> 50 THEN value END AS cleaned, coalesce(value <> 50 AND user_id <> 50, false) AS valid,
    least(greatest(value, 10.0), 60.0) AS clipped, CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.4f', value) END AS shown, CAST(round_even((event_id - 250) / 500.0, 0) AS BIGINT) AS place, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS print FROM events""")
def value_helpers(spark, sf):
    e = b.table(spark, sf, "events")
    start = F.col("ts").cast("date")
    return e.select(
        "event_id", fn.month_start(F.col("ts")).alias("month"), fn.mid_date(start, F.date_add(start, (F.col("event_id") % 9).cast("int"))).alias("middle"), fn.clean(F.col("value"), 50.0).alias("cleaned"),
        F.coalesce(fn.all_valid(["value", "user_id"], 50.0), F.lit(False)).alias("valid"), fn.clip(F.col("value"), 10.0, 60.0).alias("clipped"), fn.metric_text(F.col("value")).alias("shown"),
        fn.lattice_index(F.col("event_id"), 500.0).alias("place"), fn.fingerprint("event_id", "event_type").alias("print"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(l_discount >= 0.05, false) AS by_cover, coalesce(l_quantity >= 25, false) AS by_area, l_linenumber NOT IN (3, 8, 9, 10, 11) AS cloud_free,
    CASE WHEN l_discount >= 0.08 THEN 'strong' WHEN l_discount >= 0.04 THEN 'some' ELSE 'none' END AS verdict FROM lineitem""")
def presence_rules(spark, sf):
    li = b.table(spark, sf, "lineitem")
    cover, area = F.col("l_discount"), F.col("l_quantity")
    steps = [(cover >= 0.08, "strong"), (cover >= 0.04, "some")]
    return li.select("l_orderkey", "l_linenumber", rules.presence(cover, area, "cover", 0.05).alias("by_cover"), rules.presence(cover, area, "area", 25.0).alias("by_area"), rules.cloud_free(F.col("l_linenumber")).alias("cloud_free"), rules.ladder(steps, "none").alias("verdict"))


@query(f"""WITH {PANEL} SELECT cell, month, CAST(lead(mi) OVER (PARTITION BY cell ORDER BY mi) - mi - 1 AS INT) AS missing_after FROM panel""")
def calendar_gap_flags(spark, sf):
    return calendar.gaps(b.panel(spark, sf), ["cell"]).select("cell", "month", "missing_after")


RASTER = "r AS (SELECT p_size::BIGINT AS iy, p_partkey % 40 AS ix, p_size::BIGINT * 1000 + p_partkey % 40 AS cell, (avg(p_retailprice) > 1400)::INT AS code FROM part GROUP BY 1, 2)"
REACH = """e AS (SELECT a.cell AS a, q.cell AS b FROM r a JOIN r q ON abs(a.ix - q.ix) <= 1 AND abs(a.iy - q.iy) <= 1 AND a.code = q.code AND a.code = 1),
    reach AS (SELECT a AS cell, b AS other FROM e UNION SELECT reach.cell, e.b FROM reach JOIN e ON reach.other = e.a), p AS (SELECT cell, min(other) AS patch FROM reach GROUP BY 1)"""


def raster_cells(spark, sf):
    part = b.table(spark, sf, "part")
    return part.groupBy(F.col("p_size").cast("long").alias("iy"), (F.col("p_partkey") % 40).alias("ix")).agg((F.avg("p_retailprice") > 1400).cast("int").alias("code")).withColumn("cell", F.col("iy") * 1000 + F.col("ix"))


@query(f"""WITH RECURSIVE {RASTER}, {REACH}, n AS (SELECT patch, count(*) AS n FROM p GROUP BY 1) SELECT r.cell, code, CASE WHEN code = 1 AND coalesce(n, 1) < 5 THEN 0 ELSE code END AS cleaned FROM r LEFT JOIN p USING (cell) LEFT JOIN n USING (patch)""")
def patch_filter(spark, sf):
    return zonal.drop_small_patches(raster_cells(spark, sf), "code", 1, 0, 5).select("cell", "code", "cleaned")


@query(f"""WITH RECURSIVE {RASTER}, {REACH} SELECT patch, count(*) AS n_cells, min(ix) AS min_ix, max(ix) AS max_ix, min(iy) AS min_iy, max(iy) AS max_iy FROM p JOIN r USING (cell) GROUP BY 1 HAVING count(*) >= 3""")
def review_patches(spark, sf):
    return zonal.patch_table(raster_cells(spark, sf), "code", 1, 3)


@query("""WITH p AS (SELECT c_custkey AS point, c_acctbal AS x, c_nationkey * 400.0 AS y FROM customer) SELECT point, polygon FROM p, (VALUES (1, 0.0, 4000.0, 1000.0, 6000.0), (2, 3000.0, 9000.0, 5000.0, 8000.0)) z(polygon, x0, x1, y0, y1) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1
    UNION ALL SELECT point, 3 FROM p WHERE y >= 0 AND y < 4000 AND x >= 5000 + y / 4 AND x < 9000 - y * 3 / 4""")
def points_in_polygons(spark, sf):
    rings = [(1, [(0.0, 1000.0), (4000.0, 1000.0), (4000.0, 6000.0), (0.0, 6000.0)]), (2, [(3000.0, 5000.0), (9000.0, 5000.0), (9000.0, 8000.0), (3000.0, 8000.0), (3000.0, 5000.0)]), (3, [(5000.0, 0.0), (9000.0, 0.0), (6000.0, 4000.0)])]
    polygons = spark.createDataFrame(rings, "polygon int, ring array<struct<x:double,y:double>>")
    points = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("point"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 400.0).alias("y"))
    return zonal.within(points, polygons, 3000.0)


@query("""WITH RECURSIVE b AS (SELECT s_suppkey::BIGINT AS blob, s_acctbal AS x, s_nationkey * 300.0 AS y FROM supplier), e AS (SELECT a.blob AS a, c.blob AS b FROM b a JOIN b c ON (a.x - c.x) ** 2 + (a.y - c.y) ** 2 <= 160000),
    reach AS (SELECT a AS blob, b AS other FROM e UNION SELECT reach.blob, e.b FROM reach JOIN e ON reach.other = e.a) SELECT blob, min(other) AS zone FROM reach GROUP BY 1""")
def review_zones(spark, sf):
    blobs = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("blob"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 300.0).alias("y"))
    return zonal.zones(blobs, 400.0)


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size * 30.0 END, p_retailprice) AS distance, coalesce(p_size % 3 > 0 AND abs(p_size * 30.0 - p_retailprice) > 250, false) AS disagrees FROM part""")
def distance_backfill(spark, sf):
    p = b.table(spark, sf, "part").withColumn("baked", F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 30.0))
    return zonal.backfill_distance(p, "p_retailprice", "baked", 250.0).select("p_partkey", "distance", "disagrees")


@query("""SELECT p_partkey, round(p_size + p_retailprice / 1000 - (SELECT avg(p_retailprice / 1000) FROM part), 6) AS effective_depth FROM part""")
def effective_depths(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("depth"), (F.col("p_retailprice") / 1000).alias("level"))
    return rounded(panel.effective_depth(p).select("p_partkey", "effective_depth"), effective_depth=6)


@query("""SELECT p_partkey, least(p_retailprice / (36.0 * 36.0), 1.0) AS fraction FROM part""")
def valid_fractions(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", fn.valid_fraction(F.col("p_retailprice"), 36.0).alias("fraction"))


@query("""WITH r AS (SELECT event_id, value / 1000 AS a, (event_id % 7) / 100.0 AS b, (event_id % 11) / 100.0 AS c, (event_id % 5) / 100.0 AS d, (event_id % 3) / 100.0 AS e FROM events),
    i AS (SELECT *, c - b - (d - b) * ((708.75 - 681.25) / (753.75 - 681.25)) AS mci, greatest(b, c, d) AS t, CASE WHEN b = greatest(b, c, d) THEN 681.25 WHEN c = greatest(b, c, d) THEN 708.75 ELSE 753.75 END AS w FROM r), j AS (SELECT *, t - a - (e - a) * ((w - 665) / (885 - 665.0)) AS mph FROM i)
    SELECT event_id, CASE WHEN a IS NOT NULL THEN round(greatest(0, least(300, 1000 * mci * mci + 200 * mci + 5)), 6) END AS chl_mci, CASE WHEN a IS NOT NULL THEN round(greatest(0, least(300, 800 * mph * mph + 100 * mph + 2)), 6) END AS chl_mph FROM j""")
def chlorophyll_indices(spark, sf):
    k = F.col("event_id")
    r = b.table(spark, sf, "events").select(k, (F.col("value") / 1000).alias("r665"), (k % 7 / 100.0).alias("r681"), (k % 11 / 100.0).alias("r709"), (k % 5 / 100.0).alias("r754"), (k % 3 / 100.0).alias("r885"))
    got = fn.chlorophyll({"mci": (1000.0, 200.0, 5.0), "mph": (800.0, 100.0, 2.0)}, (0.0, 300.0))
    return rounded(r.select("event_id", *(c.alias(n) for n, c in got.items())), chl_mci=6, chl_mph=6)


@query("""WITH t AS (SELECT event_id, (hour(ts) + minute(ts) / 60.0) AS h, dayofyear(ts) AS d, (event_id % 120 - 60)::DOUBLE AS lat, (event_id % 360 - 180)::DOUBLE AS lon FROM events), g AS (SELECT *, 2 * pi() / 365 * (d - 1 + (h - 12) / 24) AS g FROM t),
    s AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g)
    SELECT event_id, round(greatest(0.05, least(1.0, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((h * 60 + eq + 4 * lon) / 4 - 180)))), 6) AS cosine FROM s""")
def solar_zenith(spark, sf):
    k = F.col("event_id")
    cosine = fn.solar_zenith_cosine(F.col("ts"), (k % 120 - 60).cast("double"), (k % 360 - 180).cast("double"))
    return rounded(b.table(spark, sf, "events").select("event_id", cosine.alias("cosine")), cosine=6)


# --- streams, run until their input ends, against the same sums in SQL ------------------------------------------

def event_stream(spark, sf):
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


BATCHES = 5


@contextmanager
def event_batches(spark, sf, late: bool):
    """Events as a stream of files that come one after another, each a fifth of the time, and the time by which rows may be late. late: a tenth of the rows come one file later.
    A last row of a far time lets the watermark pass all others."""
    at, e = table_path(spark, "event-files"), b.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
    low, high = e.agg(F.unix_date(F.min("ts").cast("date")), F.unix_date(F.max("ts").cast("date"))).first()
    days = max(1, -(-(high - low + 1) // BATCHES)) if low is not None else 1
    batch = F.floor((F.unix_date(F.col("ts").cast("date")) - F.lit(low or 0)) / days) + (F.when(F.col("event_id") % 10 == 3, 1).otherwise(0) if late else 0)
    dealt = materialize(e.withColumn("_batch", batch), "event-batches")
    for k in range(BATCHES + late):  # files are read in the order in which they came
        dealt.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(at)
    last = [F.lit(-1).cast(f.dataType).alias(f.name) if f.name == "event_id" else (F.date_add(F.date_from_unix_date(F.lit(high or 0)), 3650).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in e.schema]
    for _ in range(2):
        spark.range(1).select(*last).coalesce(1).write.mode("append").parquet(at)
    yield spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at), f"{(1 + late) * days + 1} days"
    delete(spark, at)
    delete(spark, dealt._table_path)


def finished(spark, frame, mode, keys=None):
    """What a stream leaves behind: the rows of an upsert table, or all rows put out."""
    at = table_path(spark, "stream")
    if keys:
        monitor.run_to_end(frame, mode, spark, f"{at}/checkpoint", monitor.upsert_sink(spark, f"{at}/out", keys))
        out = materialize(monitor.latest(spark, f"{at}/out"), "stream-out")
    else:
        monitor.run_to_end(frame, mode, spark, f"{at}/checkpoint", lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}"))
        out = materialize(spark.read.parquet(f"{at}/out").drop("epoch"), "stream-out")
    delete(spark, at)
    return out


@query("""SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, round(sum(value), 4) AS total, count(value) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_monthly_totals(spark, sf):
    got = finished(spark, monitor.monthly_totals(event_stream(spark, sf), ["event_type"], "ts", "value"), "update", ["event_type", "month"])
    return rounded(got, total=4)


@query("""SELECT user_id, arg_max(event_id, value * 1000000 + event_id) AS event_id, max(value * 1000000 + event_id) AS rank FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1""")
def stream_keep_better(spark, sf):
    stream = event_stream(spark, sf).filter("value is not null and user_id is not null").select("user_id", "event_id", (F.col("value") * 1000000 + F.col("event_id")).alias("rank"))
    return finished(spark, monitor.keep_better(stream, ["user_id"], "rank"), "update", ["user_id"])


@query(f"""WITH {OBS}, s AS (SELECT point, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY point ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM obs), g AS (SELECT point, ts, sum(b) OVER (PARTITION BY point ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT point, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY point, k""")
def session_table(spark, sf):
    """Rows late by a file; sessions come out once the watermark has passed them."""
    with event_batches(spark, sf, True) as (stream, late):
        got = finished(spark, monitor.sessions(stream.filter("user_id is not null or event_id = -1").withColumnRenamed("user_id", "point"), "point", "ts", "12 hours", late), "append")
        return got.select("point", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def daily_window_totals(spark, sf):
    """Rows late by a file; days come out once the watermark has passed them."""
    with event_batches(spark, sf, True) as (stream, late):
        got = finished(spark, monitor.daily_windows(stream, "ts", ["event_type"], "value", late), "append")
        return rounded(got.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "total", "n"), total=4)


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(floor(value * 100) AS BIGINT) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    w AS (SELECT user_id, d, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
    SELECT user_id, date_diff('day', DATE '1970-01-01', d) AS day, n AS n_obs, CASE WHEN n >= 3 THEN round(m, 4) END AS mean, CASE WHEN n >= 3 THEN round(s, 4) END AS std FROM w""")
def stream_lookback(spark, sf):
    """Each observation against its user's last seven days, from state that goes once the watermark has passed what it is for."""
    with event_batches(spark, sf, False) as (stream, late):
        rows = stream.filter("user_id is not null").select("user_id", "ts", F.unix_date(F.col("ts").cast("date")).cast("long").alias("day"), F.floor(F.col("value") * 100).cast("double").alias("value"))
        got = finished(spark, monitor.lookback_state(rows, "user_id", "day", "value", 7, when="ts", late=late), "append")
        return rounded(got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mean", "std")}), mean=4, std=4)


# --- sources and sinks ---------------------------------------------------------------------------------------

@query("""SELECT 'region' || n_regionkey AS layer, count(*) AS n, min(n_name) AS first FROM nation WHERE n_regionkey <> 3 GROUP BY 1""")
def layered_table(spark, sf):
    at, n = table_path(spark, "layers"), b.table(spark, sf, "nation")
    for k in range(5):
        sources.write_layer(n.filter(F.col("n_regionkey") == k), at, f"region{k}")
    sources.write_layer(n.filter("n_regionkey = 1"), at, "region1")
    sources.drop_layer(spark, at, "region3")
    names = sources.layers(spark, at)
    out = materialize(spark.read.parquet(at).filter(F.col("layer").isin(names)).groupBy("layer").agg(F.count("*").alias("n"), F.min("n_name").alias("first")), "layer-rows")
    delete(spark, at)
    return out


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS sensor, n_name AS status FROM nation""")
def run_log_scan(spark, sf):
    at = table_path(spark, "log")
    b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("sensor"), F.col("n_name").alias("status")).coalesce(1).write.csv(at, header=True)
    out = materialize(sources.read_log(spark, at, ["sensor", "status"], spark.createDataFrame([], "sensor string, status string").schema), "log-rows")
    delete(spark, at)
    return out


@query("""SELECT 'kind=' || n_regionkey AS parent, '.parquet' AS suffix, CAST(1 AS BIGINT) AS n_files FROM nation GROUP BY n_regionkey""")
def file_inventory(spark, sf):
    at = table_path(spark, "inventory")
    b.table(spark, sf, "nation").withColumn("kind", F.col("n_regionkey")).coalesce(1).write.partitionBy("kind").parquet(at)
    found = sources.scan_files(spark, at, "*.parquet").filter(F.col("size") > 0)
    out = materialize(sources.folder_summary(found).select("parent", "suffix", "n_files"), "inventory-rows")
    delete(spark, at)
    return out


@query("""SELECT n_nationkey AS key, CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS state, n_name AS name FROM nation WHERE n_nationkey < 20 OR n_regionkey = 2""")
def cached_and_upserted(spark, sf):
    at, n = table_path(spark, "cache"), b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    base = sources.cached(spark, at, uuid.uuid5(uuid.NAMESPACE_OID, "nation").hex, lambda: n.filter("key < 20").withColumn("state", F.lit("old")))
    out = materialize(panel.upsert(base, n.filter("n_regionkey = 2").withColumn("state", F.lit("new")), ["key"]).select("key", "state", "name"), "cache-rows")
    delete(spark, at)
    return out


# --- checks over bands and sensors -----------------------------------------------------------------------------

DAILY = OBS + ", daily AS (SELECT point, day, avg(value) AS value FROM obs WHERE point IS NOT NULL GROUP BY 1, 2)"
LOOK = DAILY + ", look AS (SELECT *, count(value) OVER w AS n_obs, stddev_samp(value) OVER w AS s1, stddev_pop(value) OVER w AS s0 FROM daily WINDOW w AS (PARTITION BY point ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))"


EXACT_LOOK = LOOK.replace("avg(value) AS value", "CAST(sum(CAST(value AS DECIMAL(28,12))) AS DOUBLE) / count(value) AS value")  # sums of doubles differ by the order of rows, which tips values at a cut


def daily(spark, sf):
    return b.observations(spark, sf).filter("point is not null").groupBy("point", "day").agg(fn.exact_mean("value").alias("value"))


@query(f"""WITH {LOOK}, d AS (SELECT 0 AS ddof, CASE WHEN n_obs >= 3 THEN s0 END - value / 3 AS d FROM look UNION ALL SELECT 1, CASE WHEN n_obs >= 3 THEN s1 END - value / 3 FROM look), r AS (SELECT ddof, count(d) AS n, avg(d) AS bias, sqrt(avg(d * d)) AS rmse FROM d GROUP BY 1)
    SELECT ddof, n, round(bias, 6) AS bias, round(rmse, 6) AS rmse, rmse = (SELECT min(rmse) FROM r) AS chosen FROM r""")
def ddof_validation(spark, sf):
    d = daily(spark, sf).withColumn("reference", F.col("value") / 3)
    return rounded(temporal.ddof_check(d, ["point"], "day", "value", "reference", 7), bias=6, rmse=6)


@query(f"""WITH {LOOK}, c AS (SELECT point % 5 AS grp, n_obs >= 3 AS a, value > 40 AS b FROM look) SELECT grp, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT coalesce(b, false)) AS only_local, count(*) FILTER (WHERE NOT a AND b) AS only_reference, count(*) FILTER (WHERE NOT a AND NOT coalesce(b, false)) AS neither,
    round(avg((a = coalesce(b, false))::INT), 6) AS agreement FROM c GROUP BY 1""")
def support_agreement(spark, sf):
    d = temporal.lookback(daily(spark, sf), ["point"], "day", "value", 7).withColumns({"grp": F.col("point") % 5, "reference": F.when(F.col("value") > 40, F.col("value"))})
    return rounded(temporal.support_agreement(d, ["grp"], "n_obs", "reference"), agreement=6)


@query(f"""WITH {EXACT_LOOK}, c AS (SELECT CASE WHEN n_obs >= 3 THEN s1 END AS a, value / 3 AS b, cut FROM look, (VALUES (5.0::DOUBLE), (15.0), (25.0)) t(cut)) SELECT cut, count(*) FILTER (WHERE a > cut) AS n_local, count(*) FILTER (WHERE b > cut) AS n_reference, count(*) FILTER (WHERE a > cut AND b > cut) AS n_both FROM c GROUP BY 1""")
def tail_agreement(spark, sf):
    d = temporal.lookback(daily(spark, sf), ["point"], "day", "value", 7).withColumn("reference", F.col("value") / 3)
    return temporal.tail_agreement(d, [], "std", "reference", [5.0, 15.0, 25.0])


@query(f"""WITH {LINES} SELECT cell, month, round(avg(l_discount), 12) AS l_discount_mean, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, round(sum(l_quantity), 2) AS l_quantity_sum FROM lines GROUP BY 1, 2""")
def climate_months(spark, sf):
    got = panel.climate_months(b.lines(spark, sf), ["cell", "month"], ["l_discount"], ["l_extendedprice", "l_quantity"])
    return rounded(got, l_discount_mean=12, l_extendedprice_sum=2, l_quantity_sum=2)


@query(f"""WITH {LINES} SELECT cell, round(avg(CASE WHEN l_tax > 0 THEN l_tax END), 12) AS depth_mean, count(*) AS n, round(count(*) FILTER (WHERE l_tax > 0) / count(*), 6) AS depth_fraction FROM lines GROUP BY 1""")
def bathymetry_means(spark, sf):
    p = b.lines(spark, sf).withColumn("depth", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return rounded(zonal.band_means(p, ["cell"], "depth"), depth_mean=12, depth_fraction=6)


# --- training tables ---------------------------------------------------------------------------------------------

CODES = {"BUILDING": 0, "MACHINERY": 1, "HOUSEHOLD": 2}
POINTS = """pts AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS label_code, c_acctbal / 1000 AS lon, c_nationkey / 10.0 AS lat FROM customer)"""


def labelled(spark, sf):
    c = b.table(spark, sf, "customer")
    return c.withColumn(".geo", fn.point_json(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10.0)).withColumn("class", F.lower("c_mktsegment"))


@query(f"""WITH {POINTS} SELECT c_custkey, label_code, CASE WHEN lon > 5 THEN 1 ELSE 0 END AS rule_code, CAST(floor(round(lon, 9) / 0.5) * 100000 + floor(round(lat, 9) / 0.5) AS BIGINT) AS block FROM pts WHERE label_code IS NOT NULL""")
def reference_points(spark, sf):
    rows = training.reference_points(labelled(spark, sf), CODES, F.when(F.col("lon") > 5, 1).otherwise(0), degrees=0.5)
    return rows.select("c_custkey", "label_code", "rule_code", "block")


@query(f"""WITH {POINTS}, s AS (SELECT n_nationkey AS place, 'm' || n_regionkey AS scene, n_regionkey * 2.5 AS band FROM nation) SELECT c_custkey, scene, label_code, CAST(band AS DOUBLE) AS band, 'manual' AS source FROM pts JOIN s ON s.place = c_nationkey WHERE label_code IS NOT NULL AND scene IN ('m1', 'm2')""")
def correction_rows(spark, sf):
    pts = b.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("place"), F.lit("m1; m2;").alias("scene"), "c_mktsegment")
    samples = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.concat(F.lit("m"), "n_regionkey").alias("scene"), (F.col("n_regionkey") * 2.5).alias("band"))
    return training.correction_rows(pts, samples, "scene", ["place"], CODES, "c_mktsegment").select("c_custkey", "scene", "label_code", "band", "source")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, n_regionkey * 10.0) AS a, n_regionkey + 0.5 AS b FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON c_nationkey = n_nationkey""".replace("n_regionkey * 10.0) AS a, n_regionkey + 0.5 AS b", "n_regionkey * 10.0::DOUBLE) AS a, n_regionkey + 0.5::DOUBLE AS b"))
def baked_features(spark, sf):
    c = b.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("place"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"))
    baked = b.table(spark, sf, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("place"), (F.col("n_regionkey") * 10.0).cast("double").alias("a"), (F.col("n_regionkey") + 0.5).cast("double").alias("b"))
    return training.baked_features(c, baked, ["place"], ["a", "b"]).select("c_custkey", "a", "b")


@query("""WITH t AS (SELECT o_custkey AS place, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) SELECT c_custkey AS place, v AS o_totalprice FROM customer LEFT JOIN t ON place = c_custkey""")
def first_tile_samples(spark, sf):
    tiles = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("place"), "o_orderkey", "o_totalprice")
    return training.first_tile(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("place")), tiles, ["place"], "o_orderkey", ["o_totalprice"])


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_ids, count(*) FILTER (WHERE o_custkey IS NULL) AS n_null_ids, count(*) FILTER (WHERE CASE WHEN o_totalprice < 200000 THEN 1 END IS NULL) AS n_incomplete,
    (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_missing, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_extra FROM orders""")
def manifest_checks(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_totalprice") < 200000, 1).alias("band"))
    return training.manifest_checks(o, "id", ["band"], b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query("""WITH f AS (SELECT o_orderpriority AS model, year(o_orderdate) AS fold, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2) SELECT model, count(*) AS folds, round(avg(score), 4) AS score_mean, round(stddev_samp(score), 4) AS score_std FROM f GROUP BY 1""")
def fold_summary(spark, sf):
    f = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("fold")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(training.fold_summary(f, ["model"], ["score"]), score_mean=4, score_std=4)


@query("""SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS part FROM orders""")
def random_split(spark, sf):
    return training.random_split(b.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("""SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(o_orderkey || '|' || coalesce(o_orderstatus, '~')), 1, 12))::BIGINT) AS DECIMAL(38, 0)) AS fingerprint FROM orders""")
def paired_set_fingerprint(spark, sf):
    return training.set_fingerprint(b.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("""WITH f AS (SELECT o_orderstatus AS arm, year(o_orderdate) AS fold, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2), d AS (SELECT a.arm, a.score - b.score AS d FROM f a JOIN f b ON a.fold = b.fold AND b.arm = 'F' WHERE a.arm <> 'F')
    SELECT arm, count(d) AS folds, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS std, count(*) FILTER (WHERE d > 0) AS wins FROM d GROUP BY 1""")
def arm_differences(spark, sf):
    f = b.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("arm"), F.year("o_orderdate").alias("fold")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(training.arm_differences(f, "fold", "arm", "F", "score"), mean=4, std=4)


@query("""WITH p AS (SELECT l_suppkey AS point, l_linenumber % 3 AS truth, l_orderkey % 3 AS predicted FROM lineitem), w AS (SELECT point, predicted, count(*) AS n FROM p WHERE truth <> predicted GROUP BY 1, 2), t AS (SELECT point, predicted, row_number() OVER (PARTITION BY point ORDER BY n DESC, predicted) AS k FROM w)
    SELECT p.point, count(*) AS n, count(*) FILTER (WHERE truth <> p.predicted) AS n_wrong, any_value(t.predicted) AS taken_for FROM p LEFT JOIN t ON t.point = p.point AND k = 1 GROUP BY 1""")
def point_difficulty(spark, sf):
    p = b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("point"), (F.col("l_linenumber") % 3).alias("truth"), (F.col("l_orderkey") % 3).alias("predicted"))
    return training.point_difficulty(p, "point", "truth", "predicted")


@query("""SELECT o_orderkey, c_mktsegment, CASE WHEN c_custkey IS NOT NULL THEN o_orderstatus = CASE WHEN c_nationkey < 12 THEN 'F' ELSE 'O' END END AS agrees FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def merge_with_provenance(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("run"))
    c = b.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment", F.when(F.col("c_nationkey") < 12, "F").otherwise("O").alias("run"))
    return panel.merge_checked(o, c, ["k"], ["run"]).select("o_orderkey", "c_mktsegment", "agrees")


@query()
def synthetic_series(spark, sf):
    return panel.synthetic_months(spark, 108)
