"""Sources, sinks, models and streams."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwork.operators import models, polygons, texture, training
from shoalwork.sources import files
from shoalwork.streaming import monitor


def test_scan_log_and_layers(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/x.tif").write_bytes(b"123")
    (tmp_path / "in/y.csv").write_text("sensor,status\nS1,ok\n")
    found = {r.name: (r.suffix, r["size"], r.parent) for r in files.scan_files(spark, str(tmp_path / "in")).collect()}
    assert found["x.tif"] == (".tif", 3, "a") and len(found) == 2
    assert files.read_log(spark, str(tmp_path / "in/y.csv"), ["sensor"]).count() == 1
    with pytest.raises(ValueError):
        files.read_log(spark, str(tmp_path / "in/y.csv"), ["prefix"])
    at = str(tmp_path / "layers")
    files.write_layer(spark.range(3), at, "one")
    files.write_layer(spark.range(5), at, "two")
    files.write_layer(spark.range(1), at, "one")
    assert files.layers(spark, at) == ["one", "two"] and spark.read.parquet(at).count() == 6
    assert files.drop_layer(spark, at, "one") and files.layers(spark, at) == ["two"]
    assert files.read_or_empty(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), "k", lambda: made.append(1) or spark.range(4)).count() == 4
    assert made == [1]


def test_rings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    assert files.rings(spark, str(tmp_path / "a.json")).first().ring[1] == [1.0, 0.0]


def events(spark, n=300):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i % 7, t0 + dt.timedelta(hours=5 * i), float(i % 13)) for i in range(n)], "event_id long, user_id long, ts timestamp, value double")


def test_stream_equals_batch(spark, tmp_path):
    batch = events(spark)
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = monitor.upsert_sink(spark, str(tmp_path / "out"), ["user_id", "month"])
    monitor.run_to_end(monitor.monthly_totals(stream, ["user_id"], "ts", "value"), "update", spark, str(tmp_path / "cp"), sink)
    got = monitor.latest(spark, str(tmp_path / "out"))
    want = monitor.monthly_totals(batch, ["user_id"], "ts", "value")
    assert sorted(map(tuple, got.select("user_id", "month", "total", "n").collect())) == sorted(map(tuple, want.collect()))


def test_lookback_state_equals_window(spark, tmp_path):
    batch = events(spark, 120).select("user_id", F.unix_date(F.col("ts").cast("date")).cast("long").alias("day"), "value").groupBy("user_id", "day").agg(F.sum("value").alias("value"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    rows = []
    monitor.run_to_end(monitor.lookback_state(stream, "user_id", "day", "value", 7), "append", spark, str(tmp_path / "cp"), lambda df, _: rows.extend(df.collect()))
    from shoalwork.operators import temporal

    want = temporal.lookback(batch.withColumn("d", F.date_from_unix_date(F.col("day").cast("int"))), ["user_id"], "d", "value", 7)
    assert {(r.user_id, r.day): r.n_obs for r in rows} == {(r.user_id, r.day): r.n_obs for r in want.collect()}


def test_models_learn_and_score(spark):
    df = spark.range(240).select((F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 4).cast("int").alias("fold"), ((F.col("id") % 3) * 2.0 + F.rand(1)).alias("a"), F.when(F.col("id") % 9 != 0, F.rand(2)).alias("b"))
    found, scores = models.cross_validate(df, ["a", "b"], {k: v for k, v in models.candidates().items() if k in ("logistic", "weighted_forest")})
    assert found.count() == 480 and scores.agg(F.min("accuracy")).first()[0] > 0.9
    fit = models.pipeline(models.candidates()["forest"], ["a", "b"]).fit(df)
    assert models.importance(fit, ["a", "b"])[0][0] == "a"
    assert models.score(fit, df).filter("class = label").count() > 220


def test_logistic_fits_read_rows_alike_once(spark, monkeypatch):
    """Fits to rows with their number are those to the rows, with class weights, gaps and a constant; a fit has as many rows as there are different ones."""
    r = np.random.default_rng(2)
    rows = [(int(r.integers(3)), int(r.integers(2)), float(a := r.integers(5)), float(r.integers(4) + 90 * a), 7.0) for _ in range(1500)]
    df = spark.createDataFrame([(min(2, label + (a > 3)), fold, a, b if b % 4 else None, c) for label, fold, a, b, c in rows], "label int, fold int, a double, b double, c double")
    given, fit = [], models.LogisticRegression.fit
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, rows, *more: given.append(rows.count()) or fit(self, rows, *more))
    predictors, names = ["a", "b", "c"], ("logistic", "weighted_logistic")
    got, scores = models.cross_validate(df, predictors, {n: models.candidates()[n] for n in names})
    most = df.select("label", *predictors).distinct().count()
    assert len(given) == 4 and max(given) <= most < 70 and got.count() == 3000
    for name in names:
        whole = models.pipeline(models.candidates()[name], predictors).fit(models.balanced(df))
        shares = [sorted(map(tuple, m.transform(df).select(*predictors, models.vector_to_array("probability").alias("p")).distinct().collect()), key=str) for m in (whole, models.fitted(models.candidates()[name], predictors, df))]
        assert all(x[:3] == y[:3] and np.allclose(x[3], y[3], atol=1e-4) for x, y in zip(*shares)) and len(shares[0]) == len(shares[1])
    arms = training.scope_ablation(df.filter("b is not null"), predictors, "logistic", {"all": F.lit(True), "few": F.col("a") < 3}, F.col("label") > 0)
    assert arms.count() == 4 and max(given[-4:]) <= most


def test_calibrations(spark):
    df = spark.range(100).select((F.col("id") / 100).alias("x"), (F.col("id") / 50 + 1).alias("y"))
    fit = models.calibrate(df, "x", "y", "linear").stages[-1]
    assert fit.coefficients[0] == pytest.approx(2.0, abs=1e-6) and models.calibrate(df, "x", "y", "identity") is None
    assert len(models.elastic_net(df.withColumn("z", F.rand(3)), ["x", "z"], "y", 0.5, 0.01)) == 2
    assert models.calibrate(df, "x", "y").boundaries.size > 0


def test_upsert_sink_replays_and_keeps_one_row_per_key(spark, tmp_path):
    at = str(tmp_path / "t")
    write = monitor.upsert_sink(spark, at, ["k"], 3)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k long, v long, w string")
    for epoch, batch in enumerate((frame((1, 1, "a"), (2, 1, "a")), frame((1, 2, "b"), (1, 3, "c"), (3, 1, "x")), frame((2, 9, "z")), frame((2, 10, "y")))):
        write(batch, epoch)
        write(batch, epoch)  # a retry
        if epoch == 1:
            assert {(r.k, r.v) for r in monitor.latest(spark, at).collect()} == {(1, 3), (2, 1), (3, 1)}
    assert {tuple(r) for r in monitor.latest(spark, at).select("k", "v", "w").collect()} == {(1, 3, "c"), (2, 10, "y"), (3, 1, "x")}
    assert all(len(v) <= 2 for v in monitor._versions(spark, at).values())
    assert monitor.latest(spark, str(tmp_path / "none")) is None


def test_late_rows_find_their_window_whole(spark, tmp_path):
    schema = "k string, day long, value double"
    for i, rows in enumerate(([("a", d, float(d)) for d in range(1, 11)], [("a", 5, 100.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = []
    for i in (0, 1):  # two runs of one query: the second brings a row that is late
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in" / str(i)) if i == 0 else str(tmp_path / "in"))
        monitor.run_to_end(monitor.lookback_state(stream, "k", "day", "value", 6, 1), "append", spark, str(tmp_path / f"cp{i}"), lambda df, _: got.extend(df.collect()))
    late = [r for r in got if r.day == 5]
    assert {r.n_obs for r in late} >= {5, 6}


def test_texture_of_one_window_and_distance_over_gaps(spark):


    r = np.random.default_rng(2)
    grid = r.integers(-1, 4, (7, 9)).astype(np.int32)
    got = texture.cooccurrence(grid, 3, 4)
    for i, j in ((0, 0), (3, 4), (6, 8), (2, 7)):
        w = np.full((3, 3), -1)
        for a in range(3):
            for b in range(3):
                if 0 <= i + a - 1 < 7 and 0 <= j + b - 1 < 9:
                    w[a, b] = grid[i + a - 1, j + b - 1]
        m = np.zeros((4, 4))
        for a in range(3):
            for b in range(3):
                for da, db in texture.STEPS:
                    if 0 <= a + da < 3 and 0 <= b + db < 3 and w[a, b] >= 0 and w[a + da, b + db] >= 0:
                        m[w[a, b], w[a + da, b + db]] += 1
                        m[w[a + da, b + db], w[a, b]] += 1
        if not m.sum():
            assert np.isnan(got[0][i, j])
            continue
        p = m / m.sum()
        d = (np.subtract.outer(np.arange(4), np.arange(4))) ** 2
        want = ((p / (1 + d)).sum(), -(p[p > 0] * np.log(p[p > 0])).sum(), (p * d).sum())
        assert [v[i, j] for v in got] == pytest.approx(list(want))
    places = [(int(a), int(b), int(r.random() < 0.04)) for a in range(40) for b in range(60) if r.random() < 0.7]
    found = {(x.row, x.col): x.distance for x in texture.distance_to_class(spark.createDataFrame(places, "row long, col long, code int"), "code", 1).collect()}
    hits = np.array([p[:2] for p in places if p[2]])
    assert len(found) == len(places)
    for a, b, _ in places:
        assert found[a, b] == pytest.approx(np.sqrt(((hits - [a, b]) ** 2).sum(1)).min())
    assert texture.distance_to_class(spark.createDataFrame(places[:5], "row long, col long, code int"), "code", 9).filter("distance is not null").count() == 0


@pytest.mark.parametrize("share", [0.002, 0.05, 1.0])
def test_distance_across_tiles(spark, share, capsys):
    """Tiles with and without targets, gaps, places below zero; few targets are many tiles away."""
    r = np.random.default_rng(9)
    places = [(int(a), int(b), int(r.random() < share)) for a in range(-40, 50) for b in range(-30, 90) if r.random() < 0.6 and not (0 < a < 20 and 10 < b < 50)] + [(400, 300, 0), (-41, 0, 1)]
    df = spark.createDataFrame([(*p, 7, 8) for p in places] + [(None, 1, 1, 7, 8), (1, None, 1, 7, 8), (500, 1, None, 7, 8)], "row long, col long, code int, tr int, _hit int")
    got = texture.distance_to_class(df, "code", 1, tile=8)
    found = {(x.row, x.col): x.distance for x in got.collect()}
    hits = np.array([p[:2] for p in places if p[2]])
    assert len(found) == len(places) + 1
    for a, b in [p[:2] for p in places] + [(500, 1)]:
        assert found[a, b] == pytest.approx(np.sqrt(((hits - [a, b]) ** 2).sum(1)).min())
    got.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def traced(label):
    """Area, length and holes of each patch of a small lattice {(x, y): label}, by filling."""
    todo, out = set(label), {}
    while todo:
        patch, stack = set(), [todo.pop()]
        while stack:
            x, y = stack.pop()
            patch.add((x, y))
            near = [(x + a, y + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
            stack += [p for p in near if p in todo and label[p] == label[x, y] and not todo.discard(p)]
        xs, ys = [p[0] for p in patch], [p[1] for p in patch]
        free = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - patch
        parts = 0
        while free:
            parts += 1
            stack = [free.pop()]
            while stack:
                x, y = stack.pop()
                stack += [p for p in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if p in free and not free.discard(p)]
        sides = sum((x + a, y + b) not in patch for x, y in patch for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        out[min(patch)] = (len(patch), sides, parts - 1)
    return out


def test_polygons(spark):
    r = np.random.default_rng(3)
    label = {(x, y): int(r.random() < 0.75) for x in range(-6, 14) for y in range(-5, 12) if r.random() < 0.95}
    number = {p: i for i, p in enumerate(sorted(label))}
    cells = spark.createDataFrame([(number[p], *p, v) for p, v in label.items()] + [(9999, 50, 50, None)], "cell long, ix int, iy int, label int")
    got = polygons.polygons(cells, "label").collect()
    where = {i: p for p, i in number.items()}
    assert {where[g.polygon]: (g.area, g.length, g.n_holes) for g in got} == traced(label) and max(g.n_holes for g in got) >= 2
    every = polygons.rings(cells, "label").collect()
    assert all(sum(not x.is_hole for x in every if x.polygon == g.polygon) == 1 for g in got) and sum(x.area for x in every) == len(label)
    corners = {}
    for v in sorted(polygons.vertices(cells, "label").collect(), key=lambda v: (v.ring, v.seq)):
        corners.setdefault(v.ring, []).append((v.x, v.y))
    assert set(corners) == {x.ring for x in every}
    for x in every:
        c = corners[x.ring]
        steps = list(zip(c, c[1:] + c[:1]))
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in steps) and sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in steps) == x.length
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in steps) / 2 == x.area
    assert polygons.polygons(cells.limit(0), "label").collect() == []


def test_polygons_across_tiles(spark):
    """Patches over several tiles, two labels, places below 0; the cells are read once, and only stretches that leave a tile are linked between tiles."""
    r = np.random.default_rng(5)
    label = {(x, y): "pq"[int(r.random() < 0.45)] for x in range(-70, 75) for y in range(-9, 70) if r.random() < 0.97}
    number = {p: i for i, p in enumerate(sorted(label))}
    read, linked = spark.sparkContext.accumulator(0), []

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    made = spark.createDataFrame([(number[p], *p, v) for p, v in label.items()], "cell int, ix int, iy int, label string")
    ring_of = polygons.ring_of
    polygons.ring_of = lambda links: linked.append(links.count()) or ring_of(links)
    try:
        got = polygons.polygons(made.mapInArrow(seen, made.schema), "label").collect()
    finally:
        polygons.ring_of = ring_of
    where = {i: p for p, i in number.items()}
    assert {where[g.polygon]: (g.area, g.length, g.n_holes) for g in got} == traced(label) and all(g.label == label[where[g.polygon]] for g in got)
    assert read.value == len(label) and 0 < linked[0] < sum(g.length for g in got) / 10


def test_whole_tiles():
    """Tables of whole tiles, whatever batches they come in."""
    import pyarrow as pa

    tx = np.repeat(np.arange(9), [1, 5, 2, 7, 1, 1, 12, 3, 4]).astype("int64")
    rows = pa.table({"tx": tx, "ty": tx // 3, "n": np.arange(len(tx))})
    for size in (1, 3, 10, 50):
        got = list(polygons._whole_tiles(iter(rows.to_batches(max_chunksize=size)), 4))
        assert pa.concat_tables(got).equals(rows) and len(got) > 1 - (size == 50)
        tiles = [set(t["tx"].to_pylist()) for t in got]
        assert sum(map(len, tiles)) == 9


def merged_in_rounds(spark, parts, borders, least_cells, least_area, most_distance=float("inf")):
    from shoalwork.operators.regions import merge_small

    table = spark.createDataFrame([(p["id"], p["n_cells"], p["area"], p["f"]) for p in parts], "id long, n_cells long, area double, f double")
    edges = spark.createDataFrame(borders, "a long, b long")
    return {r.part: r.into for r in merge_small(table, edges, ["f"], least_cells, least_area, most_distance).collect()}


def test_merging_is_that_of_one_at_a_time(spark):
    from .merge_one_at_a_time import merge_small

    parts = [{"id": i, "n_cells": n, "area": float(n), "f": f} for i, n, f in ((1, 9, 0.0), (2, 1, 0.2), (3, 2, 1.0), (4, 8, 1.1), (5, 1, 5.0))]
    assert merge_small(parts, [(1, 2), (2, 3), (3, 4)], ["f"], 4, 0.0) == {1: 1, 2: 1, 3: 4, 4: 4, 5: 5} == merged_in_rounds(spark, parts, [(1, 2), (2, 3), (3, 4)], 4, 0.0)
    chain = [{"id": i, "n_cells": 1, "area": 1.0, "f": float(i)} for i in range(6)]
    into = merge_small(chain, [(i, i + 1) for i in range(5)], ["f"], 3, 0.0)
    assert all(into[v] == v for v in into.values()) and min(list(into.values()).count(v) for v in set(into.values())) >= 3


@pytest.mark.parametrize("seed,most_distance", [(1, float("inf")), (2, 0.4)])
def test_merging_in_rounds(spark, seed, most_distance):
    """Parts on a lattice, of unlike sizes, some with others inside; ties in size and in likeness."""
    from .merge_one_at_a_time import merge_small

    r = np.random.default_rng(seed)
    parts = [{"id": i, "n_cells": int(r.integers(1, 9)), "area": float(r.integers(1, 30)), "f": round(float(r.random()), 1)} for i in range(36)]
    borders = [(i, j) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j != i + 1 or j % 6) and r.random() < 0.7]
    parts += [{"id": 100 + i, "n_cells": int(r.integers(1, 4)), "area": 2.0, "f": 0.5} for i in range(20)]
    borders += [(int(r.integers(0, 4)), 100 + i) for i in range(16)] + [(116, 117)]
    want = merge_small(parts, borders, ["f"], 7, 8.0, most_distance)
    assert merged_in_rounds(spark, parts, borders, 7, 8.0, most_distance) == want and len(set(want.values())) < 40
    assert merged_in_rounds(spark, parts, borders, 1, 0.0) == {p["id"]: p["id"] for p in parts} and merged_in_rounds(spark, [], [], 7, 8.0) == {}


def test_panel_follows_a_rewritten_part_file(spark, tmp_path):
    """Tables as folders: a part file rewritten in place, under its name, makes another panel."""
    import glob
    import shutil

    from shoalwork.plans import bindings

    data = os.environ.get("SHOALWORK_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables")
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{data}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    total = lambda f: f(spark, str(tmp_path)).agg(F.sum("valid")).first()[0]
    before = total(bindings.panel_table)
    assert before == pytest.approx(total(bindings.panel)) and total(bindings.panel_table) == before
    spark.read.parquet(f"{data}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") * 2).coalesce(1).write.parquet(f"{tmp_path}/new")
    part, = glob.glob(f"{tmp_path}/lineitem.parquet/part-*")
    for crc in glob.glob(f"{tmp_path}/lineitem.parquet/.*.crc"):
        os.remove(crc)
    shutil.copyfile(glob.glob(f"{tmp_path}/new/part-*")[0], part)
    spark.catalog.clearCache()
    after = total(bindings.panel_table)
    assert after == pytest.approx(2 * before) and after == pytest.approx(total(bindings.panel))


def test_guards_refuse_columns_and_tell_reasons(spark):
    from shoalwork.operators import rules

    df = spark.createDataFrame([(1, 2, 3, 4)], "Cover_Target int, mean_confidence int, rain int, cover_lag1 int")
    got = rules.guarded_columns(df, ["cover.*"], [".*confidence"], ["cover_lag1"])
    assert {r.column: r.reason for r in got.collect()} == {"Cover_Target": "response", "mean_confidence": "confidence", "rain": "ok", "cover_lag1": "ok"}
    rules.refuse(got.filter("column = 'rain'"), ["response", "confidence"], "predictors")
    with pytest.raises(ValueError, match="Cover_Target, mean_confidence"):
        rules.refuse(got, ["response", "confidence"], "predictors")
    files = spark.createDataFrame([(None, "a", 3), (1.0, "a", 3), (50.0, None, 3), (50.0, " ", 3), (50.0, "b", 3), (50.0, "a", None), (50.0, "a", 1), (50.0, "a", 2)], "size double, tag string, version int")
    assert [r.reason for r in rules.provenance_reasons(files, "size", "tag", "version", 10, ["a"], 2).collect()] == ["unreadable", "too small", "no tag", "no tag", "other run", "old version", "old version", "ok"]


def test_lookback_state_goes_with_the_watermark(spark, tmp_path):
    """Keys that stop have no state once later times have passed; rows that come late still see their own window."""
    first = dt.datetime(2024, 1, 1)
    batches = [[("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 5.0)], [("a", 3, 4.0), ("a", 2, 3.0)], [("c", 200, 1.0)], [("c", 201, 1.0)]]
    day0 = (first.date() - dt.date(1970, 1, 1)).days
    for k, rows in enumerate(batches):
        data = [(key, first + dt.timedelta(days=d), day0 + d, v) for key, d, v in rows]
        spark.createDataFrame(data, "k string, ts timestamp, day long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, day long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    progress = monitor.run_to_end(monitor.lookback_state(stream, "k", "day", "value", 7, 1, when="ts", late="10 days"), "append", spark, str(tmp_path / "cp"), lambda df, _: got.extend(df.collect()))
    assert {(r.k, r.day - day0): (r.n_obs, r["mean"]) for r in got} == {("a", 0): (1, 1.0), ("a", 1): (2, 1.5), ("b", 0): (1, 5.0), ("a", 2): (3, 2.0), ("a", 3): (4, 2.5), ("c", 200): (1, 1.0), ("c", 201): (2, 1.0)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(held) >= 4 and max(held) == 3 and held[-1] == 1


def test_deviations_of_windows_side_by_side():
    """Against each window by itself, in one part and in parts smaller than a window; large values keep their small deviations."""
    from shoalwork.streaming import monitor

    r = np.random.default_rng(2)
    values = 1e9 + r.normal(size=400)
    low = r.integers(0, 400, 300)
    high = np.minimum(400, low + r.integers(0, 40, 300))
    want = [values[a:b].std(ddof=1) if b - a > 1 else np.nan for a, b in zip(low, high)]
    for at_once in (7, 1_000_000):
        np.testing.assert_allclose(monitor.deviations(values, low, high, at_once), want, rtol=1e-6)
    assert len(monitor.deviations(values, low[:0], high[:0])) == 0
