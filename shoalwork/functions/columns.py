"""Column expressions: dates, transforms, geometry, names and small statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- calendar -------------------------------------------------------------

def month_start(when: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(when.cast("date"), "MM")


def month_index(when: Column) -> Column:
    """Running number of a month: 12 * year + month - 1."""
    return (F.year(when) * 12 + F.month(when) - 1).cast("int")


def month_of_index(index: Column) -> Column:
    """The date that month_index maps to `index`."""
    return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))


def mid_date(start: Column, end: Column) -> Column:
    """The day halfway between two dates, rounded down; a missing end counts as the start."""
    end = F.coalesce(end, start)
    return F.date_add(start.cast("date"), F.floor(F.datediff(end, start) / 2).cast("int"))


def season_terms(when: Column, harmonics: int = 2) -> dict[str, Column]:
    """Sine and cosine of each harmonic of the year."""
    turn = F.month(when) * (2 * math.pi / 12)
    return {f"{name}{k}": fn(turn * k) for k in range(1, harmonics + 1) for name, fn in (("sin", F.sin), ("cos", F.cos))}


def in_window(start: Column, end: Column, low: Column, high: Column, mode: str = "overlap") -> Column:
    """Whether a period meets a window; a missing end counts as the start."""
    end = F.coalesce(end, start)
    tests = {"overlap": (start <= high) & (end >= low), "start_within": (start >= low) & (start <= high), "contained": (start >= low) & (end <= high)}
    if mode not in tests:
        raise ValueError(f"unknown mode {mode!r}")
    return tests[mode]


# --- values ---------------------------------------------------------------

def clean(x: Column, nodata: float | None = None) -> Column:
    """Null for NaN, infinities and the nodata value; comparisons are then safe."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    if nodata is not None:
        bad = bad | (x == F.lit(nodata))
    return F.when(~bad, x)


def all_valid(columns: list[str], nodata: float | None = None) -> Column:
    """Whether every column has a usable value."""
    return reduce(lambda a, b: a & b, [clean(F.col(c).cast("double"), nodata).isNotNull() for c in columns])


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def transform(x: Column, how: str = "logit", eps: float = 1e-4) -> Column:
    """identity, log (of x, at least eps) or logit (of x held within eps and 1 - eps)."""
    if how == "identity":
        return x
    if how == "log":
        return F.ln(F.greatest(x, F.lit(eps)))
    if how == "logit":
        held = clip(x, eps, 1 - eps)
        return F.ln(held / (1 - held))
    raise ValueError(f"unknown transform {how!r}")


def inverse_transform(y: Column, how: str = "logit", eps: float = 1e-4) -> Column:
    if how == "identity":
        return y
    if how == "log":
        return F.exp(y)
    if how == "logit":
        return 1 / (1 + F.exp(-y))
    raise ValueError(f"unknown transform {how!r}")


def enough(value: Column, count: Column, least: int = 3) -> Column:
    """The value where at least so many observations stand behind it."""
    return F.when(count >= least, value)


def variation(std: Column, mean: Column, floor: float = 1e-6) -> Column:
    """Coefficient of variation; null where the mean is about zero."""
    return F.when(F.abs(mean) >= floor, std / F.abs(mean))


def left_closed_bin(x: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Label of the bin [low, high) that holds x; null outside."""
    labels = labels or [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:])]
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x >= a) & (x < b), label).otherwise(out)
    return out


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The text of the first check that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in checks))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals. What lies halfway goes to the even digit, as in C and Python; format_string would round it up."""
    text = F.call_function("format_number", x, F.lit(f"0.{'0' * digits}" if digits else "0"))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)


def metric_text(x: Column, digits: int = 4) -> Column:
    return F.coalesce(fixed(x, digits), F.lit("N/A"))


def whole(x: Column) -> Column:
    """The largest whole number up to x as a double: zero keeps its sign, and what is no number or too large for a long stays as it is."""
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) >= float(1 << 53)), x).otherwise(F.floor(x).cast("double"))


def byte_text(n: Column) -> Column:
    """A size with its unit, up to TB: whole bytes, two decimals of larger units."""
    out = F.concat(fixed(n.cast("double") / float(1024**4), 2), F.lit(" TB"))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        text = F.concat(fixed(n.cast("double") / float(1024**i), 2 if i else 0), F.lit(f" {unit}"))
        out = F.when(F.abs(n) < F.lit(float(1024 ** (i + 1))), text).otherwise(out)
    return F.when(n.isNotNull(), out)


def is_blank(text: Column) -> Column:
    """Null, or one of the ways an empty cell is written."""
    return text.isNull() | F.trim(text).isin("", "nan", "None")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' values as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# --- space ----------------------------------------------------------------

def block_id(lon: Column, lat: Column, degrees: float = 0.1) -> Column:
    """Number of the square block of that many degrees."""
    return (F.floor(lon / degrees) * 100000 + F.floor(lat / degrees)).cast("long")


def lattice_index(center: Column, size: float) -> Column:
    """Place of a cell's centre on the lattice; halves go to the even neighbour."""
    return F.rint((center - size / 2) / size).cast("long")


def cell_of(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - origin) / size).cast("long")


def point_json(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def point_of_json(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a GeoJSON point; nulls if it is none."""
    at = F.from_json(text, "coordinates array<double>")["coordinates"]
    return F.get(at, 0), F.get(at, 1)


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by counting crossings of its edges."""
    crossings = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 == y1:
            continue
        spans = (y >= min(y0, y1)) & (y < max(y0, y1))
        crossings.append(F.when(spans & (x < F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))), 1).otherwise(0))
    return sum(crossings, F.lit(0)) % 2 == 1


def distance_to_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Least distance to the edges of a polygon."""
    out = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x1 - x0, y1 - y0
        length = dx * dx + dy * dy
        t = clip(((x - x0) * dx + (y - y0) * dy) / length, 0.0, 1.0) if length else F.lit(0.0)
        out.append(F.sqrt(F.pow(x - (F.lit(x0) + t * dx), 2) + F.pow(y - (F.lit(y0) + t * dy), 2)))
    return F.least(*out) if len(out) > 1 else out[0]


def wind(u: Column, v: Column, axis_degrees: float) -> dict[str, Column]:
    """Speed, direction blown to, and the parts along and across an axis."""
    axis = math.radians(axis_degrees)
    return {
        "speed": F.sqrt(u * u + v * v),
        "direction": F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0)),
        "along": u * math.sin(axis) + v * math.cos(axis),
        "across": u * math.cos(axis) - v * math.sin(axis),
    }


def pixel_area_ha(a: float, b: float, d: float, e: float, unit: float = 1.0) -> float:
    """Area of a pixel of an affine grid in hectares."""
    return abs(a * e - b * d) * unit * unit / 10_000


def geodesic_band_ha(lat_low: Column, lat_high: Column, width_degrees: float) -> Column:
    """Area between two latitudes on the WGS84 ellipsoid, in hectares."""
    a, f = 6378137.0, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    b = a * (1 - f)

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - e * e * s * s) + F.ln((1 + e * s) / (1 - e * s)) / (2 * e)

    return (q(lat_high) - q(lat_low)) * (b * b / 2 * math.radians(width_degrees) / 10_000)


# Fourier coefficients of the equation of time (minutes) and of the sun's declination (radians): constant, then cosine and sine of each harmonic of the year.
EQUATION_OF_TIME = (0.000075, (0.001868, -0.032077), (-0.014615, -0.040849))
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))


def solar_zenith_cosine(when: Column, lat: Column, lon: Column) -> Column:
    """Cosine of the sun's zenith angle, held within 0.05 and 1 so that reflectances stay finite at dusk and by night."""
    hour = F.hour(when) + F.minute(when) / 60.0
    turn = 2 * math.pi / 365 * (F.dayofyear(when) - 1 + (hour - 12) / 24)

    def series(terms) -> Column:
        return reduce(lambda a, b: a + b, (c * F.cos(k * turn) + s * F.sin(k * turn) for k, (c, s) in enumerate(terms[1:], 1)), F.lit(terms[0]))

    decl = series(DECLINATION)
    angle = F.radians((hour * 60 + 229.18 * series(EQUATION_OF_TIME) + 4 * lon) / 4 - 180)
    return clip(F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(angle), 0.05, 1.0)


# Centres (nm) of the bands that the chlorophyll indices use, and the longest and shortest base line.
CHLOROPHYLL_BANDS = {"r665": 665.0, "r681": 681.25, "r709": 708.75, "r754": 753.75, "r885": 885.0}


def peak_height(peak: Column, at: Column | float, low: Column, low_at: float, high: Column, high_at: float) -> Column:
    """How far a band stands above the line between two others."""
    return peak - low - (high - low) * ((at - low_at) / (high_at - low_at))


def calibrated(index: Column, coefficients: tuple[float, float, float], bounds: tuple[float, float]) -> Column:
    """A quadratic of an index, held within bounds."""
    a, b, c = coefficients
    return clip(a * index * index + b * index + c, *bounds)


def chlorophyll(coefficients: dict[str, tuple[float, float, float]], bounds: tuple[float, float]) -> dict[str, Column]:
    """chl_mci and chl_mph of columns r665 to r885 (reflectances): the 709 nm peak over its neighbours, and the highest
    of three peaks over a long base line (the shorter wavelength where peaks tie). coefficients: a quadratic for each."""
    nm, r = CHLOROPHYLL_BANDS, {b: F.col(b) for b in CHLOROPHYLL_BANDS}
    top = F.greatest(r["r681"], r["r709"], r["r754"])
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in r.values()))
    at = F.when(r["r681"] == top, nm["r681"]).when(r["r709"] == top, nm["r709"]).otherwise(nm["r754"])
    mci = peak_height(r["r709"], nm["r709"], r["r681"], nm["r681"], r["r754"], nm["r754"])
    mph = peak_height(top, at, r["r665"], nm["r665"], r["r885"], nm["r885"])
    return {f"chl_{name}": F.when(whole, calibrated(x, coefficients[name], bounds)) for name, x in (("mci", mci), ("mph", mph))}


def reflectance(radiance: Column, scale: float, irradiance: float, cosine: Column) -> Column:
    """Top-of-atmosphere reflectance of a scaled radiance under the sun's zenith cosine."""
    return radiance * scale * math.pi / irradiance / cosine


def valid_fraction(area: Column, cell_size: float) -> Column:
    """Share of a square cell that was seen, at most 1."""
    return F.least(area / (cell_size * cell_size), F.lit(1.0))


# --- aggregates -----------------------------------------------------------

def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; null if either is constant (never raises)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def exact_mean(x: str) -> Column:
    """Mean whose sum is exact, so that the order of rows cannot carry it over a threshold; plain where a value has over 12 decimals, is too large, or is not finite."""
    exact = F.col(x).try_cast("decimal(28,12)")
    whole = F.count_if(exact.cast("double") == F.col(x)) == F.count(x)
    return F.when(whole, F.try_divide(F.try_sum(exact).cast("double"), F.count(x))).otherwise(F.avg(x))


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean of the values that are there, by weight."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))
