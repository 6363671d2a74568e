"""Queries over catalogues of exports, rasters, run logs and grids, with their SQL. Files are made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import catalog
from . import bindings as b
from .registry import query

FORM_LIST = "['s2_predictors_s2_whlev_temporal_v1', 's2_predictors_s2_whlev_texture_v1', 's2_predictors', 's1_scc_temporal_v1', 's1_scc_predictors', 's1_predictors', 's2_other']"
DAY, COPY = "[0-9]{4}-[0-9]{2}-[0-9]{2}", " [(][0-9]+[)]"
NAMES = f"^(site_(s2_predictors_s2_whlev_temporal_v1|s2_predictors_s2_whlev_texture_v1|s2_predictors|s1_scc_temporal_v1|s1_scc_predictors|s1_predictors)_({DAY})_to_({DAY}))(-[0-9]{{10}}-[0-9]{{10}})?$"

FILES = f"""files AS (SELECT DISTINCT 'exports/site_' || list_extract({FORM_LIST}, CAST(o_custkey % 7 + 1 AS INT)) || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_to_' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')
        || (CASE WHEN o_orderkey % 3 = 0 THEN '-0000000000-0000000512' ELSE '' END) || (CASE WHEN o_orderkey % 5 = 0 THEN ' (1)' ELSE '' END) || (CASE o_orderstatus WHEN 'F' THEN '.tif' WHEN 'O' THEN '.TIF' ELSE '' END) AS path, o_orderkey, o_orderkey % 2 AS place, o_totalprice AS size FROM orders),
    bare AS (SELECT *, string_split(path, '/')[-1] AS name, regexp_replace(regexp_replace(string_split(path, '/')[-1], '(?i)[.]tiff?$', ''), '{COPY}$', '') AS bare FROM files),
    found AS (SELECT *, regexp_extract(bare, '{NAMES}', ['prefix', 'form', 's', 'e', 'tile']) AS m FROM bare),
    parsed AS (SELECT path, o_orderkey, place, size, nullif(m.prefix, '') AS prefix, CASE WHEN m.form LIKE 's2%' THEN 'S2' WHEN m.form LIKE 's1%' THEN 'S1' END AS sensor, TRY_CAST(nullif(m.s, '') AS DATE) AS start_date, TRY_CAST(nullif(m.e, '') AS DATE) AS end_date,
        nullif(regexp_extract(m.form, '(s2_whlev_[a-z]+_v1|s1_scc_temporal_v1)$', 1), '') AS token, CASE WHEN m.prefix <> '' THEN m.tile <> '' END AS is_tile, regexp_matches(name, '{COPY}([.][^.]+)?$') AS is_copy FROM found)"""


def files(spark, sf):
    o = b.table(spark, sf, "orders")
    path = f"""concat('exports/site_', element_at(array{FORM_LIST.replace('[', '(').replace(']', ')')}, cast(o_custkey % 7 + 1 as int)), '_', date_format(o_orderdate, 'yyyy-MM-dd'), '_to_', date_format(date_add(cast(o_orderdate as date), 1), 'yyyy-MM-dd'),
        case when o_orderkey % 3 = 0 then '-0000000000-0000000512' else '' end, case when o_orderkey % 5 = 0 then ' (1)' else '' end, case o_orderstatus when 'F' then '.tif' when 'O' then '.TIF' else '' end)"""
    return o.selectExpr(f"{path} AS path", "o_orderkey", "o_orderkey % 2 AS place", "o_totalprice AS size").distinct()


@query(f"WITH {FILES} SELECT o_orderkey, prefix, sensor, start_date, end_date, token, is_tile, is_copy FROM parsed")
def export_names(spark, sf):
    return catalog.parse_names(files(spark, sf)).select("o_orderkey", "prefix", "sensor", "start_date", "end_date", "token", "is_tile", "is_copy")


@query(f"""WITH {FILES} SELECT CASE WHEN prefix IS NULL THEN 'name not understood' WHEN is_copy THEN 'copy' WHEN sensor = 'S1' AND token IS NULL THEN 'no temporal bands' WHEN size < 50000 THEN 'too small' ELSE 'accepted' END AS outcome, count(*) AS n FROM parsed GROUP BY 1""")
def selection_audit(spark, sf):
    p = catalog.parse_names(files(spark, sf))
    checks = [(F.col("prefix").isNull(), "name not understood"), (F.col("is_copy"), "copy"), ((F.col("sensor") == "S1") & F.col("token").isNull(), "no temporal bands"), (F.col("size") < 50000, "too small")]
    return catalog.audit(catalog.with_reasons(p, checks), [])


@query(f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor, start_date ORDER BY (token IS NOT NULL) DESC, prefix DESC, o_orderkey) AS k FROM parsed WHERE prefix IS NOT NULL)
    SELECT sensor, start_date, prefix, o_orderkey FROM r WHERE k = 1""")
def winner_per_key(spark, sf):
    p = catalog.parse_names(files(spark, sf)).filter("prefix is not null")
    w = catalog.winners(p, ["sensor", "start_date"], [F.col("token").isNotNull().desc(), F.desc("prefix"), F.asc("o_orderkey")])
    return w.select("sensor", "start_date", "prefix", "o_orderkey")


@query(f"""WITH {FILES} SELECT sensor, prefix, string_agg(path, ';' ORDER BY path) AS paths, count(*) AS n_files FROM parsed WHERE prefix IS NOT NULL AND NOT is_copy GROUP BY 1, 2""")
def snapshot_files(spark, sf):
    return catalog.group_files(catalog.parse_names(files(spark, sf)).filter("prefix is not null and not is_copy"), ["sensor", "prefix"])


@query(f"""WITH {FILES} SELECT sensor, start_date, is_tile, count(*) AS n FROM parsed WHERE prefix IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def ambiguous_rasters(spark, sf):
    p = catalog.parse_names(files(spark, sf)).filter("prefix is not null")
    return catalog.ambiguous(p, ["sensor", "start_date"], "is_tile")


@query(f"""WITH {FILES}, g AS (SELECT *, min(place) OVER (PARTITION BY prefix) AS first FROM parsed WHERE NOT is_copy AND (token = 's2_whlev_temporal_v1' OR token = 's1_scc_temporal_v1') AND start_date >= DATE '1994-01-01')
    SELECT prefix, sensor, start_date, end_date, place, string_agg(path, ';' ORDER BY path) AS paths, count(*) AS n_files FROM g WHERE place = first GROUP BY ALL""")
def export_sets(spark, sf):
    return catalog.export_sets(files(spark, sf), {"S2": "s2_whlev_temporal_v1", "S1": "s1_scc_temporal_v1"}, first="1994-01-01")


@query(f"""WITH {FILES}, c AS (SELECT path, regexp_matches(name, '-[0-9]{{10}}-[0-9]{{10}}[.]') AS t FROM bare WHERE starts_with(name, 'site_s1_scc_temporal_v1_199') AND regexp_matches(name, '(?i)[.]tiff?$') AND NOT regexp_matches(name, '{COPY}[.]'))
    SELECT path FROM c WHERE t = (SELECT max(t) FROM c)""")
def located_exports(spark, sf):
    return catalog.locate(files(spark, sf), "site_s1_scc_temporal_v1_199").select("path")


# --- classified rasters -----------------------------------------------------

TAILS = "['_local_rf', '_local_rf_patch_cleaned', '_local_rules', '_local_rules_patch_cleaned', '_local_rf_proba', '_tile_3', '_local_lr', '']"
CURRENT = {"S2": "site_s2_predictors_s2_whlev_temporal_v1", "S1": "site_s1_scc_temporal_v1"}
STARTS = "['site_s2_predictors_s2_whlev_temporal_v1', 'site_s1_scc_temporal_v1', 'site_s2_predictors', 'site_s1_scc_temporal_v1']"
RASTERS = f"""o AS (SELECT *, list_extract({STARTS}, CAST(o_custkey % 4 + 1 AS INT)) || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_to_' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS scene, list_extract({TAILS}, CAST(o_orderkey % 8 + 1 AS INT)) AS tail FROM orders),
    rasters AS (SELECT DISTINCT 'maps/' || scene || tail || (CASE WHEN o_orderkey % 13 = 0 THEN ' (2)' ELSE '' END) || (CASE WHEN o_orderkey % 11 = 0 THEN '.csv' ELSE '.tif' END) AS path, scene FROM o),
    log AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Completed ' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status, scene AS prefix, CASE WHEN tail LIKE '_local_rf' OR tail LIKE '_local_rf_patch_cleaned' THEN 'old/run/' || scene || tail || '.tif' ELSE 'nan' END AS model_tif, CASE WHEN tail = '_local_rules' THEN ' ' || scene || tail || '.tif' ELSE ' ' END AS rule_tif FROM o),
    done AS (SELECT prefix, CASE WHEN model_tif <> 'nan' THEN string_split(model_tif, '/')[-1] END AS m, nullif(trim(rule_tif), '') AS r FROM log WHERE lower(trim(status)) = 'completed'),
    logged AS (SELECT m AS file_name FROM done UNION SELECT CASE WHEN m LIKE '%@_patch@_cleaned.tif' ESCAPE '@' THEN replace(m, '_patch_cleaned', '') ELSE replace(m, '.tif', '_patch_cleaned.tif') END FROM done UNION SELECT r FROM done UNION SELECT prefix || '_local_rules.tif' FROM done),
    parts AS (SELECT path, string_split(path, '/')[-1] AS file_name, regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '') AS stem FROM rasters),
    bases AS (SELECT *, regexp_replace(stem, '_patch_cleaned$', '') AS base, CASE WHEN starts_with(file_name, 'site_s2_predictors_s2_whlev_temporal_v1') THEN 'S2' WHEN starts_with(file_name, 'site_s1_scc_temporal_v1') THEN 'S1' END AS sensor FROM parts),
    kinds AS (SELECT *, CASE WHEN regexp_matches(stem, '_tile_[0-9]+$') THEN 'tile_intermediate' WHEN base LIKE '%@_proba' ESCAPE '@' THEN 'probability' WHEN base LIKE '%@_local@_rules' ESCAPE '@' THEN 'rules' WHEN contains(base, '_local_') THEN 'model' ELSE 'unknown' END AS kind,
        nullif(regexp_extract(base, '_local_(.*)$', 1), '') AS any_slug, TRY_CAST(nullif(regexp_extract(stem, '({DAY})_to_({DAY})', 1), '') AS DATE) AS start_date, TRY_CAST(nullif(regexp_extract(stem, '({DAY})_to_({DAY})', 2), '') AS DATE) AS end_date, ends_with(stem, '_patch_cleaned') AS cleaned FROM bases),
    told AS (SELECT *, CASE WHEN kind = 'model' THEN any_slug END AS slug, CASE WHEN NOT regexp_matches(file_name, '(?i)[.]tiff?$') THEN 'not a raster' WHEN regexp_matches(stem, '{COPY}$') THEN 'copy of another file' WHEN sensor IS NULL THEN 'not of the current schema' WHEN kind NOT IN ('model', 'rules') THEN 'not a final classification'
        WHEN start_date IS NULL THEN 'no dates in the name' END AS reason FROM kinds)"""


def orders_as_scenes(spark, sf):
    def listed(items: str) -> str:
        return f"array({items[1:-1]})"

    return b.table(spark, sf, "orders").selectExpr(
        "*", f"concat(element_at({listed(STARTS)}, cast(o_custkey % 4 + 1 as int)), '_', date_format(o_orderdate, 'yyyy-MM-dd'), '_to_', date_format(date_add(cast(o_orderdate as date), 1), 'yyyy-MM-dd')) AS scene", f"element_at({listed(TAILS)}, cast(o_orderkey % 8 + 1 as int)) AS tail")


def rasters(spark, sf):
    return orders_as_scenes(spark, sf).selectExpr("concat('maps/', scene, tail, case when o_orderkey % 13 = 0 then ' (2)' else '' end, case when o_orderkey % 11 = 0 then '.csv' else '.tif' end) AS path", "scene").distinct()


def run_log(spark, sf):
    return orders_as_scenes(spark, sf).selectExpr(
        "case o_orderstatus when 'F' then 'Completed ' when 'O' then 'completed' else 'failed' end AS status", "scene AS prefix",
        "case when tail in ('_local_rf', '_local_rf_patch_cleaned') then concat('old/run/', scene, tail, '.tif') else 'nan' end AS model_tif", "case when tail = '_local_rules' then concat(' ', scene, tail, '.tif') else ' ' end AS rule_tif")


@query(f"WITH {RASTERS} SELECT path, sensor, kind, slug, start_date, end_date, cleaned, CASE WHEN kind = 'model' THEN CASE sensor WHEN 'S2' THEN 'Route_B_' ELSE 'Route_B_SCC_' END || any_slug ELSE CASE sensor WHEN 'S2' THEN 'Paper_rules' ELSE 'Paper_rules_SCC' END END AS method, reason FROM told")
def raster_descriptions(spark, sf):
    return catalog.describe_rasters(rasters(spark, sf), CURRENT).select("path", "sensor", "kind", "slug", "start_date", "end_date", "cleaned", "method", "reason")


@query(f"WITH {RASTERS} SELECT file_name FROM logged WHERE file_name IS NOT NULL")
def run_log_names(spark, sf):
    return catalog.run_log_names(run_log(spark, sf))


@query(f"WITH {RASTERS} SELECT m AS file_name FROM done WHERE m IS NOT NULL AND m NOT IN (SELECT file_name FROM parts) UNION SELECT r FROM done WHERE r IS NOT NULL AND r NOT IN (SELECT file_name FROM parts)")
def run_log_missing(spark, sf):
    return catalog.run_log_missing(run_log(spark, sf), rasters(spark, sf))


SELECTED = f"""{RASTERS}, checked AS (SELECT * EXCLUDE (reason), coalesce(reason, CASE WHEN file_name NOT IN (SELECT file_name FROM logged WHERE file_name IS NOT NULL) THEN 'not in the run log' WHEN kind = 'model' AND sensor = 'S2' AND slug <> 'rf' THEN 'not the wanted model' END) AS reason FROM told),
    counted AS (SELECT *, count(DISTINCT base) OVER w AS bases, count(*) FILTER (WHERE cleaned) OVER w AS n_cleaned, count(*) FILTER (WHERE NOT cleaned) OVER w AS n_raw FROM checked WINDOW w AS (PARTITION BY sensor, kind, start_date, end_date, reason IS NULL)),
    selected AS (SELECT *, coalesce(reason, CASE WHEN bases > 1 OR n_cleaned > 1 OR n_raw > 1 THEN 'ambiguous' WHEN n_cleaned = 1 AND n_raw = 1 AND NOT cleaned THEN 'superseded by its cleaned raster' END) AS outcome FROM counted)"""


def selected(spark, sf):
    return catalog.select_rasters(rasters(spark, sf), CURRENT, run_log(spark, sf), {"S2": "rf"})


@query(f"WITH {SELECTED} SELECT path, outcome AS reason, outcome IS NULL AS accepted FROM selected")
def raster_selection(spark, sf):
    return selected(spark, sf).select("path", "reason", "accepted")


@query(f"WITH {SELECTED} SELECT sensor, kind, coalesce(outcome, 'accepted') AS outcome, count(*) AS n FROM selected GROUP BY 1, 2, 3")
def raster_audit(spark, sf):
    return catalog.audit(selected(spark, sf), ["sensor", "kind"])


@query(f"WITH {RASTERS} SELECT sensor, list_sort(list(DISTINCT slug)) AS slugs FROM told WHERE reason IS NULL AND kind = 'model' GROUP BY 1 HAVING count(DISTINCT slug) > 1")
def mixed_slugs(spark, sf):
    return catalog.mixed_slugs(catalog.describe_rasters(rasters(spark, sf), CURRENT))


@query(f"""WITH {RASTERS}, p AS (SELECT path, scene, regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '') AS stem FROM rasters), q AS (SELECT *, regexp_matches(stem, '{COPY}$') AS is_copy, regexp_replace(stem, '{COPY}$', '') AS orig FROM p),
    k AS (SELECT *, regexp_replace(orig, '_patch_cleaned$', '') AS base, ends_with(orig, '_patch_cleaned') AS clean FROM q),
    t AS (SELECT *, CASE WHEN regexp_matches(orig, '_tile_[0-9]+$') OR base LIKE '%@_proba' ESCAPE '@' THEN 'other' WHEN base LIKE '%@_local@_rules' ESCAPE '@' THEN 'rules' WHEN contains(base, '_local_') THEN 'model' ELSE 'other' END AS kind, regexp_extract(base, '_local_(.*)$', 1) AS slug FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene, kind ORDER BY (CASE WHEN kind = 'model' AND NOT clean THEN 1 ELSE 0 END), (CASE WHEN kind = 'model' AND slug NOT LIKE '%lr%' THEN 1 ELSE 0 END), is_copy, path) AS place FROM t),
    s AS (SELECT scene, max(path) FILTER (WHERE kind = 'model' AND place = 1) AS model, max(slug) FILTER (WHERE kind = 'model' AND place = 1) AS slug, max(path) FILTER (WHERE kind = 'rules' AND place = 1) AS rules, count(*) FILTER (WHERE kind = 'model') AS n_models, count(*) FILTER (WHERE kind = 'rules') AS n_rules FROM r GROUP BY 1)
    SELECT *, CASE WHEN model IS NULL AND rules IS NULL THEN 'neither' WHEN model IS NULL THEN 'no model' WHEN rules IS NULL THEN 'no rules' ELSE 'paired' END AS status FROM s""")
def scene_pairs(spark, sf):
    return catalog.pair_scenes(rasters(spark, sf), "scene", preferred=("lr",))


# --- grids ------------------------------------------------------------------

GRIDS = """grids AS (SELECT o_custkey AS prefix, o_orderkey AS file, CASE WHEN o_custkey % 9 = 0 AND o_orderstatus = 'F' THEN 'EPSG:32736' ELSE 'EPSG:4326' END AS crs, 10.0::DOUBLE AS x_size, -10.0::DOUBLE AS y_size,
    ((o_orderkey % 16) * 5120 + CASE WHEN o_custkey % 7 = 0 THEN o_orderkey % 2 * 3 ELSE 0 END)::DOUBLE AS "left", (-(o_orderkey % 3) * 5120)::DOUBLE AS top, 512::BIGINT AS width, 512::BIGINT AS height FROM orders)"""


def grids(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "o_custkey AS prefix", "o_orderkey AS file", "case when o_custkey % 9 = 0 and o_orderstatus = 'F' then 'EPSG:32736' else 'EPSG:4326' end AS crs", "10d AS x_size", "-10d AS y_size",
        "cast(o_orderkey % 16 * 5120 + case when o_custkey % 7 = 0 then o_orderkey % 2 * 3 else 0 end as double) AS left", "cast(-(o_orderkey % 3) * 5120 as double) AS top", "512L AS width", "512L AS height")


@query(f"""WITH {GRIDS}, g AS (SELECT prefix, count(*) AS n_files, count(DISTINCT ("left", top, width, height)) AS n_windows, count(DISTINCT crs) AS n_crs FROM grids GROUP BY 1)
    SELECT prefix, n_files, n_windows, CASE WHEN n_files = 1 THEN 'single' WHEN n_crs > 1 THEN 'inconsistent' WHEN n_windows < n_files THEN 'duplicate_grid' ELSE 'tiled' END AS kind FROM g""")
def tile_kinds(spark, sf):
    return catalog.tile_kinds(grids(spark, sf))


@query(f"""WITH {GRIDS}, f AS (SELECT *, first_value((crs, x_size, y_size, "left", top, width, height)) OVER (PARTITION BY prefix ORDER BY file) AS g FROM grids) SELECT prefix, file FROM f WHERE (crs, x_size, y_size, "left", top, width, height) <> g""")
def grid_mismatches(spark, sf):
    return catalog.grid_mismatches(grids(spark, sf), "prefix", "file").select("prefix", "file")


@query(f"""WITH {GRIDS}, c AS (SELECT prefix, min("left") AS l, max(top) AS t, max("left" + width * x_size) AS r, min(top + height * y_size) AS bottom, count(DISTINCT crs) AS kinds FROM grids GROUP BY 1),
    s AS (SELECT prefix, bool_or(abs(("left" - l) / x_size - round_even(("left" - l) / x_size, 0)) > 1e-3) AS skewed FROM grids JOIN c USING (prefix) GROUP BY 1)
    SELECT prefix, CASE WHEN fine THEN l END AS "left", CASE WHEN fine THEN t END AS top, CASE WHEN fine THEN CAST((r - l) / 10 AS BIGINT) END AS width, CASE WHEN fine THEN CAST((t - bottom) / 10 AS BIGINT) END AS height FROM (SELECT *, NOT skewed AND kinds = 1 AS fine FROM c JOIN s USING (prefix))""")
def union_grids(spark, sf):
    return catalog.union_grids(grids(spark, sf))


# --- names and logs -----------------------------------------------------------

@query("""SELECT c_custkey, CAST(CASE c_custkey % 5 WHEN 0 THEN DATE '2020-03-01' WHEN 1 THEN DATE '2021-12-01' WHEN 2 THEN DATE '2019-07-01' WHEN 3 THEN DATE '2022-11-01' END AS DATE) AS month,
    CASE c_nationkey % 5 WHEN 0 THEN 'S1' WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'LANDSAT' END AS sensor FROM customer""")
def name_helpers(spark, sf):
    c = b.table(spark, sf, "customer")
    name = F.expr("element_at(array('d/a_2020-03-15_to_2020-04-15.tif', 'b20211231_x.tif', 'c-2019_07.tif', 'x/2022113.tiff', 'none_19-07.tif'), cast(c_custkey % 5 + 1 as int))")
    sensor = F.expr("element_at(array(' scc', 's1_SCC', 'S2 ', 'landsat', ' nan'), cast(c_nationkey % 5 + 1 as int))")
    return c.select("c_custkey", catalog.month_of_name(name).alias("month"), catalog.normal_sensor(sensor).alias("sensor"))


@query("""WITH log AS (SELECT o_custkey AS name, o_orderstatus AS mode, max_by(CASE WHEN o_totalprice > 100000 THEN 'ok' ELSE 'bad' END, o_orderkey) AS verdict FROM orders GROUP BY 1, 2)
    SELECT c_custkey AS name, c.mode AS mode, verdict FROM (SELECT c_custkey, 'F' AS mode FROM customer) c LEFT JOIN log l ON l.name = c.c_custkey AND l.mode = c.mode""")
def validation_log(spark, sf):
    log = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("mode"), F.when(F.col("o_totalprice") > 100000, "ok").otherwise("bad").alias("verdict"), F.col("o_orderkey").alias("checked"))
    files = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.lit("F").alias("mode"))
    return catalog.with_validation(files, log, ["name", "mode"]).select("name", "mode", "verdict")


@query("SELECT o_orderkey, 'run-7' AS run, 3 AS version FROM orders")
def provenance_stamp(spark, sf):
    return catalog.stamp(b.table(spark, sf, "orders").select("o_orderkey"), {"run": "run-7", "version": 3})


@query("""SELECT event_id, CASE WHEN e < 1024 THEN printf('%.0f B', e) WHEN e < 1048576 THEN printf('%.2f KB', e / 1024) WHEN e < 1073741824 THEN printf('%.2f MB', e / 1048576) ELSE printf('%.2f GB', e / 1073741824) END AS size FROM (SELECT event_id, (event_id % 1000 * 1000003 + 1)::DOUBLE AS e FROM events)""")
def byte_sizes(spark, sf):
    return b.table(spark, sf, "events").select("event_id", fn.byte_text(F.col("event_id") % 1000 * 1000003 + 1).alias("size"))
