"""Catalogues of files and scenes: parsing, reasons, winners and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_reason, is_blank

# What stands between a site's name and the dates in the name of an export, with its sensor and schema token.
FORMS = (
    ("s2_predictors_s2_whlev_temporal_v1", "S2", "s2_whlev_temporal_v1"),
    ("s2_predictors_s2_whlev_texture_v1", "S2", "s2_whlev_texture_v1"),
    ("s2_predictors", "S2", None),
    ("s1_scc_temporal_v1", "S1", "s1_scc_temporal_v1"),
    ("s1_scc_predictors", "S1", None),
    ("s1_predictors", "S1", None),
)
# Parts of the names of classified rasters.
CLEANED, RULES, PROBABILITY, MODEL, TILE = "_patch_cleaned", "_local_rules", "_proba", "_local_", "_tile_[0-9]+$"
# A day, and the mark of a second copy in a shared drive.
DAY, COPY = "[0-9]{4}-[0-9]{2}-[0-9]{2}", " [(][0-9]+[)]"
# Months in file names, most exact form first.
MONTHS = ("(20[0-9]{2})[-_]([0-9]{2})[-_][0-9]{2}", "(20[0-9]{2})([0-9]{2})[0-9]{2}", "(20[0-9]{2})[-_]([0-9]{2})", "(20[0-9]{2})([0-9]{2})")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(base_name(path), "(?<=.)[.][^.]*$", "")


def parse_names(files: DataFrame, path: str = "path", site: str = "site") -> DataFrame:
    """prefix, sensor, start_date, end_date, token (schema), is_tile and is_copy of the names of exports.

    A name is the site, one of FORMS, the dates, perhaps a tile's place, and .tif, .tiff or nothing. Copies such as
    'x (1).tif' are parsed like their originals and marked. All is null for other names (is_copy: as the name says).
    """
    name = base_name(F.col(path))
    bare = F.regexp_replace(F.regexp_replace(name, "(?i)[.]tiff?$", ""), COPY + "$", "")
    forms = "|".join(form for form, _, _ in FORMS)
    pattern = f"^({site}_({forms})_({DAY})_to_({DAY}))(-[0-9]{{10}}-[0-9]{{10}})?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(bare, pattern, i), F.lit(""))

    def of_form(values: list) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for form, value in zip((f[0] for f in FORMS), values) for x in (form, value))), part(2))

    columns = {"prefix": part(1), "sensor": of_form([f[1] for f in FORMS]), "start_date": part(3).try_cast("date"), "end_date": part(4).try_cast("date"), "token": of_form([f[2] for f in FORMS])}
    return files.withColumns(columns | {"is_tile": F.when(part(1).isNotNull(), part(5).isNotNull()), "is_copy": name.rlike(COPY + "([.][^.]+)?$")})


def month_of_name(path: Column) -> Column:
    """The first day of the month that a file's name tells (the first date of a range); null if it tells none."""
    name, out = stem(path), []
    for form in MONTHS:
        date = F.concat_ws("-", F.regexp_extract(name, form, 1), F.regexp_extract(name, form, 2), F.lit("01"))
        out.append(F.when(name.rlike(form), date))
    return F.coalesce(*out).try_cast("date")


def normal_sensor(sensor: Column) -> Column:
    """S1 or S2 for the ways a sensor is written, other names in capitals; null for blanks."""
    name = F.upper(F.trim(sensor))
    return F.when(~is_blank(sensor), F.when(name.isin("S1", "S1_SCC", "SCC"), "S1").otherwise(name))


def without_cleaned(path: Column) -> Column:
    """The stem of a raster, the same for a raw raster and its patch-cleaned twin."""
    return F.regexp_replace(stem(path), CLEANED + "$", "")


def product(path: Column) -> Column:
    """What a raster holds, by its name: model, rules, probability, tile_intermediate or unknown."""
    base = without_cleaned(path)
    return F.when(stem(path).rlike(TILE), "tile_intermediate").when(base.endswith(PROBABILITY), "probability").when(base.endswith(RULES), "rules").when(base.contains(MODEL), "model").otherwise("unknown")


def model_slug(path: Column) -> Column:
    """The name of the model that a raster comes from; null if it tells none."""
    base = without_cleaned(path)
    return F.when(base.contains(MODEL), F.regexp_extract(base, MODEL + "(.*)$", 1))


def describe_rasters(files: DataFrame, prefixes: dict[str, str], path: str = "path", rules: bool = True) -> DataFrame:
    """sensor, kind, method, slug, start_date, end_date and cleaned of classified rasters, and why a file is none.

    prefixes: the start of the current names of each sensor. reason is the first that holds; null where all is well.
    """
    name = base_name(F.col(path))
    sensor = F.coalesce(*(F.when(name.startswith(prefix), s) for s, prefix in prefixes.items()))
    kind, window = product(F.col(path)), f"({DAY})_to_({DAY})"
    # Names of the two methods, and what the radar sensor's have more.
    method = F.when(kind == "model", F.concat(F.lit("Route_B_"), F.when(sensor == "S2", "").otherwise("SCC_"), model_slug(F.col(path)))).otherwise(F.concat(F.lit("Paper_rules"), F.when(sensor == "S2", "").otherwise("_SCC")))
    checks = [
        (~name.rlike("(?i)[.]tiff?$"), "not a raster"),
        (stem(F.col(path)).rlike(COPY + "$"), "copy of another file"),
        (sensor.isNull(), "not of the current schema"),
        (~kind.isin("model", "rules"), "not a final classification"),
        (kind == "rules" if not rules else F.lit(False), "rules not wanted"),
        (~stem(F.col(path)).rlike(window), "no dates in the name"),
    ]
    got = files.withColumns({
        "file_name": name, "sensor": sensor, "kind": kind, "method": method, "slug": F.when(kind == "model", model_slug(F.col(path))),
        "start_date": F.regexp_extract(stem(F.col(path)), window, 1).try_cast("date"), "end_date": F.regexp_extract(stem(F.col(path)), window, 2).try_cast("date"), "cleaned": stem(F.col(path)).endswith(CLEANED),
    })
    return with_reasons(got, checks)


def run_log_names(log: DataFrame, done: tuple[str, ...] = ("completed",), model: str = "model_tif", rule: str = "rule_tif", prefix: str = "prefix", status: str = "status") -> DataFrame:
    """The file names that a run log accounts for: file_name, each once.

    Of every finished row the model's raster and its twin (raw and patch-cleaned), the raster of the rules, and the one that rules of
    this prefix are always written to.
    """
    rows = log.filter(F.lower(F.trim(status)).isin([d.strip().lower() for d in done]))

    def named(column: str) -> Column:
        return F.when(~is_blank(F.col(column)), base_name(F.trim(column)))

    suffix = F.regexp_extract(named(model), "(?<=.)([.][^.]*)$", 1)
    twin = F.concat(without_cleaned(named(model)), F.when(stem(named(model)).endswith(CLEANED), "").otherwise(CLEANED), suffix)
    fixed = F.when(~is_blank(F.col(prefix)), F.concat(F.trim(prefix), F.lit(RULES + ".tif")))
    return rows.select(F.explode(F.array(named(model), twin, named(rule), fixed)).alias("file_name")).filter("file_name is not null").distinct()


def run_log_missing(log: DataFrame, files: DataFrame, done: tuple[str, ...] = ("completed",), columns: tuple[str, ...] = ("model_tif", "rule_tif"), status: str = "status", path: str = "path") -> DataFrame:
    """Files that finished rows of a run log name and the folder does not hold: file_name, each once."""
    rows = log.filter(F.lower(F.trim(status)).isin([d.strip().lower() for d in done]))
    named = rows.select(F.explode(F.array(*(F.when(~is_blank(F.col(c)), base_name(F.trim(c))) for c in columns))).alias("file_name")).filter("file_name is not null").distinct()
    return named.join(files.select(base_name(F.col(path)).alias("file_name")), "file_name", "left_anti")


def select_rasters(files: DataFrame, prefixes: dict[str, str], log: DataFrame | None = None, slugs: dict[str, str] | None = None, prefer_cleaned: bool = True, path: str = "path", **log_columns) -> DataFrame:
    """Every file with what it holds, accepted or with the reason why not; one raster is accepted per sensor, kind and dates.

    Checked in turn: the name, the run log (if one is given), the model (slugs: the wanted one of each sensor), and what else there
    is for the same dates. A raw raster gives way to its cleaned twin (or the other way round); where others
    compete, all of them are ambiguous.
    """
    rows = describe_rasters(files, prefixes, path)
    checks = [(F.col("reason").isNotNull(), F.col("reason"))]
    if log is not None:
        rows = rows.join(run_log_names(log, **log_columns).withColumn("_logged", F.lit(True)), "file_name", "left")
        checks.append((F.col("_logged").isNull(), F.lit("not in the run log")))
    for sensor, slug in (slugs or {}).items():
        checks.append(((F.col("kind") == "model") & (F.col("sensor") == sensor) & (F.col("slug") != slug), F.lit("not the wanted model")))
    rows = rows.withColumn("reason", F.coalesce(*(F.when(test, why) for test, why in checks)))
    same = Window.partitionBy("sensor", "kind", "start_date", "end_date", F.col("reason").isNull())
    base, n_cleaned = without_cleaned(F.col(path)), F.sum(F.col("cleaned").cast("int")).over(same)
    n_raw = F.count("*").over(same) - n_cleaned
    rows = rows.withColumns({"_mixed": (F.min(base).over(same) != F.max(base).over(same)) | (n_cleaned > 1) | (n_raw > 1), "_pair": (n_cleaned == 1) & (n_raw == 1)})
    loses = F.col("_pair") & (F.col("cleaned") != F.lit(prefer_cleaned))
    why = F.when(F.col("_mixed"), "ambiguous").when(loses, "superseded by its cleaned raster" if prefer_cleaned else "cleaned raster not wanted")
    rows = rows.withColumn("reason", F.coalesce("reason", why))
    return rows.withColumn("accepted", F.col("reason").isNull()).drop("_mixed", "_pair", "_logged")


def mixed_slugs(rasters: DataFrame) -> DataFrame:
    """Sensors whose accepted model rasters come from more than one model: sensor and slugs. Empty: all is well."""
    models = rasters.filter("accepted and kind = 'model'")
    return models.groupBy("sensor").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).filter(F.size("slugs") > 1)


def check_tokens(prefixes: dict[str, str], tokens: dict[str, str]) -> None:
    """Raises ValueError unless every sensor's prefix carries its schema token."""
    for sensor, prefix in prefixes.items():
        if sensor not in tokens:
            raise ValueError(f"no schema token for sensor {sensor}")
        if f"_{tokens[sensor]}_" not in "_" + prefix:
            raise ValueError(f"prefix {prefix!r} of {sensor} does not carry {tokens[sensor]!r}")


def locate(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """The files of one export: its tiles if there are any, else the whole rasters; no copies."""
    name = base_name(F.col(path))
    held = files.filter(name.rlike("(?i)[.]tiff?$") & name.startswith(prefix) & ~stem(F.col(path)).rlike(COPY + "$")).withColumn("_tile", stem(F.col(path)).rlike("-[0-9]{10}-[0-9]{10}$"))
    tiles = held.agg(F.max("_tile").alias("_tiled"))  # one row
    return held.join(F.broadcast(tiles), F.col("_tile") == F.col("_tiled")).drop("_tile", "_tiled")


def tile_kinds(files: DataFrame, key: str = "prefix") -> DataFrame:
    """Whether the files of each key are one, tiles, copies of one grid, or at odds: key, n_files, n_windows and kind.

    files has crs, x_size, y_size (pixel), left, top, width and height.
    """
    res = F.struct(F.round("x_size", 6), F.round("y_size", 6))
    got = files.groupBy(key).agg(
        F.count("*").alias("n_files"), F.countDistinct("crs").alias("_crs"), F.countDistinct(res).alias("_res"), F.countDistinct(F.struct("left", "top", "width", "height")).alias("n_windows"))
    kind = F.when(F.col("n_files") == 1, "single").when((F.col("_crs") > 1) | (F.col("_res") > 1), "inconsistent").when(F.col("n_windows") < F.col("n_files"), "duplicate_grid").otherwise("tiled")
    return got.select(key, "n_files", "n_windows", kind.alias("kind"))


def grid_mismatches(files: DataFrame, key: str, order: str) -> DataFrame:
    """Files whose grid is not that of the first of their key. Empty: all grids are one."""
    grid = F.struct("crs", "x_size", "y_size", "left", "top", "width", "height")
    first = files.groupBy(key).agg(F.min_by(grid, order).alias("_grid"))
    return files.join(first, key).filter(grid != F.col("_grid")).drop("_grid")


def union_grids(files: DataFrame, key: str = "prefix") -> DataFrame:
    """The smallest grid over the files of each key: key, left, top, width, height; nulls where CRS, pixel size or alignment differ."""
    ends = files.withColumns({"_right": F.col("left") + F.col("width") * F.col("x_size"), "_bottom": F.col("top") + F.col("height") * F.col("y_size")})
    corner = ends.groupBy(key).agg(F.min("left").alias("_left"), F.max("top").alias("_top"), F.max("_right").alias("_r"), F.min("_bottom").alias("_b"))

    def off(x: Column) -> Column:
        return F.abs(x - F.rint(x)) > 1e-3

    joined = ends.join(corner, key)
    skewed = off((F.col("left") - F.col("_left")) / F.col("x_size")) | off((F.col("top") - F.col("_top")) / F.col("y_size"))
    got = joined.groupBy(key).agg(
        F.max(skewed).alias("_skewed"), F.countDistinct("crs", "x_size", "y_size").alias("_kinds"), *(F.first(c).alias(c) for c in ("_left", "_top", "_r", "_b", "x_size", "y_size")))
    fine = ~F.col("_skewed") & (F.col("_kinds") == 1)
    size = {"width": (F.col("_r") - F.col("_left")) / F.col("x_size"), "height": (F.col("_b") - F.col("_top")) / F.col("y_size")}
    return got.select(key, F.when(fine, F.col("_left")).alias("left"), F.when(fine, F.col("_top")).alias("top"), *(F.when(fine, F.rint(x).cast("long")).alias(n) for n, x in size.items()))


def pair_scenes(files: DataFrame, key: str = "prefix", path: str = "path", preferred: tuple[str, ...] = ()) -> DataFrame:
    """The best model raster and the best rules raster of every scene, and whether both are there.

    Of models the patch-cleaned one goes first, then the slug that contains the earliest of `preferred`, then originals before copies,
    then the least path; of rules originals, then the least path. One pass: the least of a struct by scene.
    """
    # a name with a copy's mark counts like its original
    original = F.regexp_replace(F.col(path), COPY + "(?=[.][^.]*$)", "")
    is_copy = stem(F.col(path)).rlike(COPY + "$").cast("int")
    slug = F.lower(model_slug(original))
    rank = F.coalesce(*(F.when(slug.contains(p.lower()), F.lit(i)) for i, p in enumerate(preferred)), F.lit(len(preferred)))
    kind, cleaned = product(original), stem(original).endswith(CLEANED)
    model = F.when(kind == "model", F.struct((~cleaned).cast("int").alias("a"), rank.alias("b"), is_copy.alias("c"), F.col(path).alias("path"), model_slug(original).alias("slug")))
    rule = F.when(kind == "rules", F.struct(is_copy.alias("a"), F.col(path).alias("path")))
    got = files.groupBy(key).agg(F.min(model).alias("_m"), F.min(rule).alias("_r"), F.count(model).alias("n_models"), F.count(rule).alias("n_rules"))
    have_model, have_rule = F.col("_m").isNotNull(), F.col("_r").isNotNull()
    status = F.when(have_model & have_rule, "paired").when(have_model, "no rules").when(have_rule, "no model").otherwise("neither")
    return got.select(key, F.col("_m.path").alias("model"), F.col("_m.slug").alias("slug"), F.col("_r.path").alias("rules"), "n_models", "n_rules", status.alias("status"))


def export_sets(files: DataFrame, tokens: dict[str, str], site: str = "site", path: str = "path", place: str = "place", first: str | None = None, last: str | None = None) -> DataFrame:
    """The files of every export that can be used: prefix, sensor, start_date, end_date, paths, n_files, place.

    place: the order of the folders searched; a prefix found in an earlier folder shadows the same one in later ones. Wanted are originals
    with the token of their sensor that begin within first and last.
    """
    rows = parse_names(files, path, site).filter(F.col("prefix").isNotNull() & ~F.col("is_copy"))
    wanted = reduce(lambda a, b: a | b, ((F.col("sensor") == s) & (F.col("token") == t) for s, t in tokens.items()), F.lit(False))
    rows = rows.filter(F.coalesce(wanted, F.lit(False)))
    if first:
        rows = rows.filter(F.col("start_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("start_date") <= F.lit(last).cast("date"))
    rows = rows.withColumn("_first", F.min(place).over(Window.partitionBy("prefix"))).filter(F.col(place) == F.col("_first"))
    return group_files(rows, ["prefix", "sensor", "start_date", "end_date", place], path)


def stamp(df: DataFrame, values: dict) -> DataFrame:
    """The rows with where they come from in further columns."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def with_validation(files: DataFrame, log: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """Files with the verdict of an earlier validation of the same file under the same settings (keys: name, size, time, settings); null: to be validated."""
    latest = log.groupBy(*keys).agg(F.max_by(verdict, "checked").alias(verdict))
    return files.join(latest, keys, "left")


def with_reasons(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """The first reason to reject each row; null for those accepted. Rejected rows stay for the audit."""
    return df.withColumn("reason", first_reason(checks)).withColumn("accepted", F.col("reason").isNull())


def audit(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def winners(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def collisions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All but the winner of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("place > 1")


def ambiguous(df: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """Keys with two rows of one variant, which no rule resolves."""
    return df.groupBy(*keys, variant).count().filter("count > 1").select(*keys, variant, F.col("count").alias("n"))


def group_files(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """One row per key with its sorted files; a key's files are the tiles of one scene, so few."""
    return files.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(path)), ";").alias("paths"), F.count("*").alias("n_files"))


def pending(planned: DataFrame, *done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that none of the other tables has."""
    for table in done:
        planned = planned.join(table.select(*keys).distinct(), keys, "left_anti")
    return planned


def refresh(manifest: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """The manifest with the newest states where there are any."""
    return manifest.join(states.select(key, F.col("status").alias("_s")), key, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def funnel(stages: list[tuple[str, DataFrame]], key: str, group: str) -> DataFrame:
    """Distinct keys of each group at every stage."""
    out = None
    for i, (name, df) in enumerate(stages):
        n = df.groupBy(group).agg(F.countDistinct(key).alias("n")).withColumn("stage", F.lit(name)).withColumn("step", F.lit(i))
        out = n if out is None else out.unionByName(n)
    return out


def distinct_parts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """Number of distinct parts of a joined list."""
    return df.select(F.explode(F.split(column, separator)).alias("part")).filter("part <> ''").agg(F.countDistinct("part").alias("n_parts"))


def newest(files: DataFrame, modified: str = "modificationTime", path: str = "path") -> DataFrame:
    return files.agg(F.max_by(path, modified).alias("newest"))


def shrunk(now: int, before: int, ratio: float = 0.9) -> str:
    """Whether a scan found suspiciously fewer files than the last."""
    if before <= 0:
        return "no baseline"
    return "collapsed" if now < before * ratio else "shrunk" if now < before else "ok"
