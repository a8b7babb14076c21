"""Scalar building blocks: plain Column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# fixed values: volumetric water content at saturation per soil layer
SOIL_SATURATION = {"swvl1": 0.472, "swvl2": 0.472, "swvl3": 0.452, "swvl4": 0.452}


def clip(col: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; null stays null."""
    out = col
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(col.isNotNull(), out)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_km(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    return F.sqrt((e1 - e2) ** 2 + (n1 - n2) ** 2) / 1000


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy, dx = (lat2 - lat1) * 111.0, (lon2 - lon1) * 111.0 * F.cos(F.radians(lat1))
    return F.sqrt(dy * dy + dx * dx)


def signed_log1p(q: Column) -> Column:
    return F.signum(q) * F.log1p(F.abs(q))


def normalised_position(v: Column, datum: Column, p90: Column) -> Column:
    """(v - datum) / (p90 - datum) within [-2, 5]; a range of 0.01 or less counts as 1."""
    span = F.when(p90 - datum > 0.01, p90 - datum).otherwise(1.0)
    return clip((v - datum) / span, -2.0, 5.0)


def log_area(area: Column) -> Column:
    return F.log1p(area)


def saturation_ratio(vwc: Column, layer: Column) -> Column:
    sat = F.create_map(*[F.lit(x) for kv in SOIL_SATURATION.items() for x in kv])
    return clip(vwc / F.try_element_at(sat, layer), 0.0, 1.0)


def number_in_text(text: Column) -> Column:
    """First number of a text such as '3.65 km2' or '12, 27'; null where there is none."""
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def base_and_segment(name: Column) -> tuple[Column, Column]:
    """'BASE_12' -> ('BASE', 12); names without a number keep their text and have no segment."""
    hit = name.rlike(r"^.*_\d+$")
    base = F.when(hit, F.regexp_extract(name, r"^(.*)_(\d+)$", 1)).otherwise(name)
    return base, F.when(hit, F.regexp_extract(name, r"^(.*)_(\d+)$", 2).try_cast("int"))


def normal_model_name(name: Column, dashes: bool = False) -> Column:
    """Lower-case name without parenthesised remarks; optionally '_' and '-' become blanks."""
    out = F.lower(F.regexp_replace(name, r"\([^)]*\)", ""))
    return F.trim(F.translate(out, "_-", "  ") if dashes else out)


def horizon_hours(value: Column, step_minutes: int = 15) -> Column:
    """Whole numbers are steps, texts such as '12 hr' name hours."""
    steps = value.try_cast("int")
    return F.when(steps.isNotNull(), steps * step_minutes / 60.0).otherwise(number_in_text(value))


def gauge_status(stage: Column) -> Column:
    s = F.coalesce(stage, F.lit(0.0))
    return F.when(s > 0.3, "high").when(s > 0.1, "moderate").otherwise("normal")


# fixed values: plausible easting and northing ranges of each coordinate system, tried in this order
CRS_RANGES = (
    ("EPSG:4326", (-10, 2), (49, 62)),
    ("EPSG:2157", (480_000, 620_000), (530_000, 960_000)),
    ("EPSG:29902", (50_000, 380_000), (10_000, 460_000)),
    ("EPSG:27700", (-200_000, 700_000), (0, 1_300_000)),
)


def coordinate_system(e: Column, n: Column) -> Column:
    """First coordinate system whose ranges hold the pair; null where none does."""
    return F.coalesce(*[F.when(e.between(*er) & n.between(*nr), code) for code, er, nr in CRS_RANGES])


def calibrated_db(dn: Column, lut: Column, offset_db: float = -83.0) -> Column:
    """10 log10(dn^2 / lut^2); without a lookup value 20 log10(dn) plus an offset; dn <= 0 -> null."""
    with_lut = F.when(lut > 0, 10 * F.log10(dn * dn / (lut * lut)))
    return F.when(dn > 0, F.when(lut.isNull(), 20 * F.log10(dn) + offset_db).otherwise(with_lut))


def travel_time_h(dist_km: Column, velocity: Column, celerity: float = 5 / 3) -> Column:
    return F.when(velocity > 0, dist_km * 1000 / (F.lit(celerity) * velocity) / 3600)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pixel_index(x: Column, origin: float, size: float, n: int) -> Column:
    """Nearest pixel of a coordinate, clipped to the raster; halves go to the even pixel."""
    return F.least(F.greatest(F.rint((x - origin) / size), F.lit(0)), F.lit(n - 1)).cast("long")


def raster_coordinate(x: Column, lo: Column, hi: Column, inverted: bool = False) -> Column:
    """Position inside [lo, hi] as -1..1; the vertical axis of a raster runs downwards."""
    out = F.try_divide(2 * (x - lo), hi - lo) - 1
    return -out if inverted else out
