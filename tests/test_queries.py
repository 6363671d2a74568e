"""Every query with SQL against DuckDB on the smallest tables, and the edges of the calendar and rules."""

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.functions import columns as fn
from shoalwork.operators import areas, calendar, catalog, components, folds, metrics, panel, panel_ar, rules, stats, temporal, zonal
from shoalwork.plans import additive_queries, audit_queries, catalog_queries, helper_queries, panel_queries, pixel_queries, region_queries, registry, scene_queries, stats_queries  # noqa: F401

DATA = os.environ.get("SHOALWORK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, tmp_path, name):
    registry.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    duck.sql(f"create or replace table o as {registry.ORACLE_SQL[name]}")
    columns = [r[0] for r in duck.sql("describe o").fetchall()]
    duck.sql(f"""create or replace table s as select {', '.join(f'"{c}"' for c in columns)} from read_parquet('{tmp_path}/out/*.parquet')""")
    assert duck.sql("select * from o except all select * from s limit 3").fetchall() == []
    assert duck.sql("select * from s except all select * from o limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def months(*indices):
    return [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in indices]


def series(spark, indices, key="a"):
    return spark.createDataFrame([(key, m, float(i)) for i, m in zip(indices, months(*indices))], "k string, month date, v double")


def test_lag_is_null_across_a_gap(spark):
    df = series(spark, [0, 1, 3, 4])
    got = {r.month: r.v_lag1 for r in calendar.calendar_lag(df, ["k"], ["v"]).collect()}
    assert [got[m] for m in months(0, 1, 3, 4)] == [None, 0.0, None, 3.0]
    prev = {r.month: r.v_prev1 for r in calendar.positional_lag(df, ["k"], ["v"]).collect()}
    assert [prev[m] for m in months(0, 1, 3, 4)] == [None, 0.0, 1.0, 3.0]


def test_densify_gaps_and_runs(spark):
    df = series(spark, [0, 1, 3, 7])
    assert calendar.densify(df, ["k"]).count() == 8
    spans = [(r.n_months, r.gap_rank) for r in calendar.gap_spans(df, ["k"]).orderBy("gap_rank").collect()]
    assert spans == [(3, 1), (1, 2)]
    assert calendar.runs(df, ["k"]).count() == 3
    assert calendar.missing_months(series(spark, [5]), ["k"]).count() == 0


def test_month_index_round_trip(spark):
    df = spark.createDataFrame([(m,) for m in months(0, 11, 12, 25)], "m date")
    assert df.filter(fn.month_of_index(fn.month_index(F.col("m"))) != F.col("m")).count() == 0


def test_lookback_keeps_day_89_and_drops_day_90(spark):
    start = dt.date(2021, 1, 1)
    df = spark.createDataFrame([("a", start + dt.timedelta(d), 1.0 + d) for d in (0, 88, 89, 90)], "k string, day date, v double")
    got = [r.n_obs for r in temporal.lookback(df, ["k"], "day", "v").orderBy("day").collect()]
    assert got == [1, 2, 3, 3]
    one = temporal.lookback(df, ["k"], "day", "v").orderBy("day").first()
    assert one["mean"] is None and one["std"] is None


def test_rules_on_thresholds_and_missing(spark):
    rows = [(0.0, 0.0, 0.9, 0), (0.0, -0.1, 0.1, 2), (0.0, -0.1, 0.63, 3), (0.0, -0.1, 0.0999, 1), (-0.01, 0.5, 0.5, 1), (float("nan"), 0.0, 0.5, 255), (None, 0.0, 0.5, 255), (float("inf"), 0.0, 0.5, 255)]
    df = spark.createDataFrame(rows, "a double, i double, m double, want int")
    assert df.filter(rules.optical_class(F.col("a"), F.col("i"), F.col("m")) != F.col("want")).count() == 0
    radar = spark.createDataFrame([(-17.0, -14.0, 0), (-16.9, -20.0, 1), (-18.0, -13.9, 2), (None, -1.0, 255)], "p double, v double, want int")
    assert radar.filter(rules.radar_class(F.col("p"), F.col("v")) != F.col("want")).count() == 0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(5)] + [("d", float(i), 2.0 * i) for i in range(5)] + [("e", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(fn.safe_corr("x", "y").alias("r")).collect()}
    assert got["c"] is None and got["e"] is None and got["d"] == pytest.approx(1.0)


def test_empty_classes_keep_zero_rows(spark):
    df = spark.createDataFrame([("s", 0), ("s", 0), ("s", 255)], "scene string, code int")
    got = {r.code: r.n_pixels for r in areas.class_area(df, ["scene"], "code", {0: "water", 1: "land", 2: "floating"}, 900.0).collect()}
    assert got == {0: 2, 1: 0, 2: 0}
    m = areas.raster_metrics(df, ["scene"], "code", 2).first()
    assert (m.n_target, m.n_valid) == (0, 2)


def test_zero_valid_area_is_null_cover(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "cell int, target double, valid double")
    assert panel.reduce_duplicates(df, ["cell"], "target", "valid").first().cover is None


def test_kappa_undefined_when_all_is_one_class(spark):
    df = spark.createDataFrame([(0, 0)] * 4, "a int, b int")
    r = metrics.agreement(df, [], "a", "b", [0, 1], 1).first()
    assert r.agreement == 1.0 and r.kappa is None and r.jaccard is None


def test_winner_and_upsert_are_total(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y"), ("j", 2, "z")], "k string, rank int, v string")
    assert sorted(r.v for r in catalog.winners(df, ["k"], [F.desc("rank"), F.asc("v")]).collect()) == ["x", "z"]
    up = panel.upsert(df.filter("v <> 'y'"), spark.createDataFrame([("k", 9, "new")], "k string, rank int, v string"), ["k"])
    assert sorted(r.v for r in up.collect()) == ["new", "z"]


def test_components_of_a_path_and_a_pair(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert components.connected_components(edges.limit(0)).count() == 0


def test_small_patches_go(spark):
    cells = spark.createDataFrame([(0, 0, 0, 2), (1, 0, 1, 2), (2, 1, 2, 2), (3, 9, 9, 2), (4, 5, 5, 1)], "cell long, ix long, iy long, code int")
    got = {r.cell: r.cleaned for r in zonal.drop_small_patches(cells, "code", 2, 0, 2).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 0, 4: 1}
    assert zonal.patch_table(cells, "code", 2).count() == 2


def test_nearest_scene_ties_and_tolerance(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    points = spark.createDataFrame([(1, "S", day(10)), (2, "S", day(40))], "id int, sensor string, day date")
    scenes = spark.createDataFrame([("b", "S", day(8), day(8)), ("a", "S", day(12), day(12)), ("c", "S", day(30), None)], "scene string, sensor string, s date, e date")
    got = {r.id: r.scene for r in temporal.nearest(points, scenes, ["sensor"], "id", "day", "s", "e", "scene", 3).collect()}
    assert got == {1: "b"}


def test_hac_and_ar_recover_known_effects(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = []
    for cell in range(30):
        e = 0.0
        for m in range(60):
            e = 0.5 * e + r.normal(0, 0.1)
            x = float(r.normal())
            rows.append((cell, months(m)[0], 1.0 + 0.8 * x + e, x))
    df = spark.createDataFrame(rows, "cell int, month date, y double, x double")
    got = {t.term: t.estimate for t in panel_ar.panel_ar(df, "cell", "y", ["x"]).collect()}
    assert got["x"] == pytest.approx(0.8, abs=0.02) and got["rho1"] == pytest.approx(0.5, abs=0.06)
    h = {t.term: t for t in stats.hac(df, "y", ["x"], 3).collect()}
    assert abs(h["x"].estimate - 0.8) < 4 * h["x"].std_error


def test_shapley_shares_add_up(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), (F.col("id") % 5).alias("c")).withColumn("y", F.col("a") + 0.5 * F.col("b") * F.col("c"))
    rows = stats.shapley_r2(df, "y", {"a": ["a"], "b": ["b"], "c": ["c"]}).collect()
    assert sum(r.shapley_r2 for r in rows) == pytest.approx(rows[0].full_r2)
    assert metrics.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-3) and metrics.chi2_tail(31.41, 20) == pytest.approx(0.05, abs=1e-3)


def test_folds_do_not_split_blocks(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 13).alias("block"))
    out = folds.block_folds(df, "block", 4, 2)
    assert out.count() == 600 and out.groupBy("block", "repeat").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_ar_roots():
    assert stats.ar_roots([0.5]) == [0.5] and stats.ar_roots([]) == []


def test_regions_of_a_small_lattice(spark):
    """Two halves by label, a speck of two cells within the left one that joins the right: regions numbered by size."""
    from shoalwork.operators import regions

    cells = [(10 * x + y, x, y, "left" if x < 2 else "right", float(x), 1.0) for x in range(5) for y in range(4)]
    cells[0] = (0, 0, 0, "right", 0.0, 1.0)
    df = spark.createDataFrame(cells, "cell long, ix long, iy long, side string, f double, area double")
    got = {r.cell: r.region for r in regions.build_regions(df, "side", ["f"], "area", 2, 0.0).collect()}
    assert len(got) == 20 and {got[c] for c in got if c >= 20} == {"R01"} and {got[c] for c in got if c < 20} == {"R02"}
    alone = regions.build_regions(df, "side", ["f"], "area", 1, 0.0).groupBy("region").count().collect()
    assert sorted((r.region, r["count"]) for r in alone) == [("R01", 12), ("R02", 7), ("R03", 1)]


@pytest.mark.parametrize("lattice", [False, True])
def test_zones_of_crowded_cells(spark, lattice):
    """Against all pairs: clumps with bridges and near misses, blobs at one place, at no place and at two; links grow with cells, not with pairs of blobs."""
    r = np.random.default_rng(5)
    at = r.uniform(0, 6, (12, 2))
    xy = np.concatenate([c + r.uniform(-0.35, 0.35, (40, 2)) for c in at] + [r.uniform(0, 6, (40, 2)), np.array([[3.0, 9.0]] * 3)])
    xy = np.round(xy, 1 if lattice else 6)
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(r.permutation(len(xy)), xy)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 8.0, 9.0), (902, 3.0, 9.05)]
    got = {q.blob: q.zone for q in zonal.zones(spark.createDataFrame(rows, "blob long, x double, y double"), 0.25).collect()}
    zone = {i: i for i, *_ in rows}
    links = [(a, c) for a, x, y in rows for c, u, v in rows if None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 0.25 * 0.25]
    moved = True
    while moved:
        moved = False
        for a, c in links:
            if zone[a] != zone[c]:
                zone[a] = zone[c] = min(zone[a], zone[c])
                moved = True
    assert got == zone and 5 < len(set(zone.values())) < 200


def test_zones_of_many_blobs_in_few_cells(spark, monkeypatch):
    """20,000 blobs in one zone: the components see links of cells, not the millions of pairs of blobs."""
    seen, real = [], zonal.connected_components
    monkeypatch.setattr(zonal, "connected_components", lambda edges: seen.append(edges.count()) or real(edges))
    blobs = spark.range(20000).select(F.col("id").alias("blob"), (F.pmod(F.col("id") * 7919, F.lit(10007)) / 10007.0 * 10).alias("x"), (F.col("id") % 25 * 0.3).alias("y"))
    assert zonal.zones(blobs, 0.4).select("zone").distinct().count() == 1
    assert sum(seen) < 20000
    assert zonal.zones(blobs.limit(0), 0.4).count() == 0


def test_nearest_matches_days_not_points(spark):
    """20,000 points of a day and 20,000 scenes of one period: a match for the day, not 400 million; equal periods go to the least id."""
    points = spark.range(20000).select(F.lit("a").alias("sensor"), "id", F.when(F.col("id") < 19990, F.lit(dt.date(2024, 1, 5))).otherwise(F.lit(dt.date(2025, 1, 1))).alias("day"))
    scenes = spark.range(20000).select(F.lit("a").alias("sensor"), (19999 - F.col("id")).alias("scene"), F.lit(dt.date(2024, 1, 3)).alias("s"), F.when(F.col("id") % 2 == 0, F.lit(dt.date(2024, 1, 4))).alias("e"))
    began = time.time()
    got = temporal.nearest(points, scenes, ["sensor"], "id", "day", "s", "e", "scene", 3)
    assert [tuple(r) for r in got.groupBy("scene", "days_off").count().collect()] == [(1, 1.5, 19990)]
    assert time.time() - began < 40
