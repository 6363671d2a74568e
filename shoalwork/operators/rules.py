"""Row-level rules: threshold classifiers, masks and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean, ratio

NODATA = 255

# Classes of the optical and radar rules and their thresholds.
OPEN_WATER, LAND, FLOATING, EMERGENT = 0, 1, 2, 3
OPTICAL = {"wet_season_index": 0.0, "index": 0.0, "moisture_low": 0.1, "moisture_high": 0.63}
RADAR = {"emergent": -17.0, "floating": -14.0}
CLOUD_CLASSES = (3, 8, 9, 10, 11)


def optical_class(p95: Column, index: Column, moisture: Column, missing: int | None = NODATA) -> Column:
    """Water-index and moisture rule: never wet is land (1), wet now is open water (0), then floating (2) within the
    moisture band and emergent (3) above it; drier is land. A missing input gives `missing`, not a guess."""
    p95, index, moisture = clean(p95), clean(index), clean(moisture)
    return (
        F.when(p95.isNull() | index.isNull() | moisture.isNull(), F.lit(missing))
        .when(p95 < OPTICAL["wet_season_index"], LAND)
        .when(index >= OPTICAL["index"], OPEN_WATER)
        .when(moisture >= OPTICAL["moisture_high"], EMERGENT)
        .when(moisture >= OPTICAL["moisture_low"], FLOATING)
        .otherwise(LAND)
    )


def radar_class(p5: Column, backscatter: Column, missing: int | None = NODATA) -> Column:
    """Backscatter rule: always bright is emergent or land (1), bright now is floating (2), else water (0)."""
    p5, backscatter = clean(p5), clean(backscatter)
    return F.when(p5.isNull() | backscatter.isNull(), F.lit(missing)).when(p5 > RADAR["emergent"], LAND).when(backscatter > RADAR["floating"], FLOATING).otherwise(OPEN_WATER)


def constrain_radar(predicted: Column, p5: Column, backscatter: Column) -> Column:
    """A model's class held to the rule: always bright is 1, and floating needs a bright backscatter."""
    return F.when(predicted == NODATA, predicted).when(p5 > RADAR["emergent"], LAND).when((predicted == FLOATING) & ~(backscatter > RADAR["floating"]), OPEN_WATER).otherwise(predicted)


def label_code(label: Column, codes: dict[str, int]) -> Column:
    """A class code from its label, in either case, or from its number; null for anything else."""
    table = F.create_map(*(F.lit(v) for pair in codes.items() for v in (pair[0].upper(), pair[1])))
    number = label.try_cast("double").cast("int")
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(label))), F.when(number.isin(*codes.values()), number))


def cloud_free(scene_class: Column) -> Column:
    return ~scene_class.isin(*CLOUD_CLASSES)


def spectral_indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """Vegetation, moisture and water indices of surface reflectances."""
    def normalized(a: Column, b: Column) -> Column:
        return ratio(a - b, a + b)

    return {
        "ndvi": normalized(nir, red), "ndmi": normalized(nir, swir1), "mndwi": normalized(green, swir1),
        "awei": blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2,
        "awei_nsh": 4 * (green - swir1) - (0.25 * nir + 2.75 * swir2),
    }


def angle_corrected(decibel: Column, angle: Column, reference: float = 38.0) -> Column:
    """Backscatter brought to a reference incidence angle by squared cosines."""
    return decibel + 10 * F.log10(F.pow(F.cos(F.radians(F.lit(reference))), 2) / F.pow(F.cos(F.radians(angle)), 2))


def disagreement_code(model: Column, rule: Column) -> Column:
    """0 where both agree, 10 (model + 1) + rule + 1 where not, 255 where either is missing."""
    missing = model.isNull() | rule.isNull() | (model == NODATA) | (rule == NODATA)
    return F.when(missing, NODATA).when(model == rule, 0).otherwise(10 * (model + 1) + rule + 1)


def review_masks(model: Column, rule: Column, probability: Column, threshold: int = 70) -> dict[str, Column]:
    """Pixels to look at by hand: unsure, disagreeing, and both; 255 where there is no class."""
    none = model.isNull() | (model == NODATA)
    unsure, differs = F.coalesce(probability < threshold, F.lit(False)), F.coalesce((rule != NODATA) & (model != rule), F.lit(False))
    return {name: F.when(none, NODATA).otherwise(test.cast("int")) for name, test in (("unsure", unsure), ("differs", differs), ("both", unsure & differs))}


def presence(cover: Column, area_ha: Column, kind: str, value: float) -> Column:
    """Whether a cell counts as occupied under a definition by cover or by area; null counts as not."""
    return F.coalesce((cover if kind == "cover" else area_ha) >= value, F.lit(False))


def ladder(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    return reduce(lambda out, step: F.when(F.coalesce(step[0], F.lit(False)), step[1]).otherwise(out), reversed(steps), F.lit(otherwise))


def assert_none(names: list[str], fragments: list[str], what: str) -> None:
    """Raises if a column's name holds one of the fragments (responses among predictors, say)."""
    bad = [n for n in names if any(f in n.lower() for f in fragments)]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def ratio_violations(df: DataFrame, value: str, part: str, whole: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose value is not part / whole."""
    return df.filter(F.abs(F.col(value) - ratio(F.col(part), F.col(whole))) > tolerance)


def guarded_columns(df: DataFrame, responses: list[str], confidence: list[str], allowed: list[str] = ()) -> DataFrame:
    """column and reason of every column of df: response (a name that matches one of those patterns), confidence (one of those) or ok. Patterns are regular expressions
    over whole lower-case names; allowed names are ok whatever they match. A row for each column of the schema."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "column string")
    low = F.lower("column")
    matches = lambda patterns: low.rlike("^(" + "|".join(patterns) + ")$") if patterns else F.lit(False)
    return names.select("column", ladder([(F.col("column").isin(*allowed) if allowed else F.lit(False), "ok"), (matches(responses), "response"), (matches(confidence), "confidence")], "ok").alias("reason"))


def refuse(guarded: DataFrame, reasons: list[str], what: str) -> None:
    """Raises if a column has one of the reasons."""
    bad = [r.column for r in guarded.filter(F.col("reason").isin(*reasons)).orderBy("column").collect()]  # columns of a schema
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def provenance_reasons(files: DataFrame, size: str, tag: str, version: str, least_size: float, run_tags: list[str], least_version: int) -> DataFrame:
    """files with reason, the first that holds: unreadable (no size), too small, no tag, other run, old version (or none); else ok."""
    none = F.col(tag).isNull() | (F.trim(F.col(tag)) == "")
    steps = [(F.col(size).isNull(), "unreadable"), (F.col(size) < least_size, "too small"), (none, "no tag"), (~F.col(tag).isin(*run_tags), "other run"), (F.col(version).isNull() | (F.col(version) < least_version), "old version")]
    return files.withColumn("reason", ladder(steps, "ok"))
