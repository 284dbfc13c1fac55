"""Column expressions: distances, grid cells, clocks, hashed randomness, scores.

Everything here is a plain Spark expression, so it stays inside whole-stage code generation.
Distances are metres; angles degrees; times epoch seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
GREAT_CIRCLE_M = 6_371_009.0  # mean radius used by great-circle tools
M_PER_DEGREE = 111_000.0
DAY_S = 86_400


def col(x: Column | str | float | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# -- geometry -----------------------------------------------------------------


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_M) -> Column:
    """Great-circle distance of two points; null where a coordinate is null."""
    dlat, dlon = F.sin(F.radians(col(lat2) - col(lat1)) / 2), F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    a = dlat * dlat + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * dlon * dlon
    # Not least(a, 1): that skips nulls and would make a null half the earth's circumference.
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def cell_x(lon, ref_lon, ref_lat, size: float) -> Column:
    return F.floor((col(lon) - col(ref_lon)) * M_PER_DEGREE * F.cos(F.radians(col(ref_lat))) / size)


def cell_y(lat, ref_lat, size: float) -> Column:
    return F.floor((col(lat) - col(ref_lat)) * M_PER_DEGREE / size)


def legacy_cell(lon, lat, size: float) -> tuple[Column, Column]:
    """Cells counted from the null island, truncated toward zero, scaled at each point's latitude."""
    return (col(lon) * M_PER_DEGREE * F.cos(F.radians(col(lat))) / size).cast("int"), (col(lat) * M_PER_DEGREE / size).cast("int")


def cell_corner(x, y, ref_lon, ref_lat, size: float) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's south-west corner."""
    return col(ref_lon) + col(x) * size / (M_PER_DEGREE * F.cos(F.radians(col(ref_lat)))), col(ref_lat) + col(y) * size / M_PER_DEGREE


def degree_scale(min_lon: float, min_lat: float, max_lon: float, max_lat: float, step: float = 0.001) -> float:
    """Least metres that ``step`` degrees span at a box's corners (a driver-side scalar)."""

    def metres(lon1, lat1, lon2, lat2):
        p, q = math.radians(lat1), math.radians(lat2)
        a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * GREAT_CIRCLE_M * math.asin(math.sqrt(a))

    corners = [(x, y) for x in (min_lon, max_lon) for y in (min_lat, max_lat)]
    return min(metres(x, y, x + dx, y + dy) for x, y in corners for dx, dy in ((step, 0), (-step, 0), (0, step), (0, -step)))


# -- clocks -------------------------------------------------------------------


def utc_offset(ts, zone: str) -> Column:
    """Seconds that ``zone`` is ahead of UTC at an instant, whatever the session's zone."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(col(ts)), zone)) - col(ts).cast("long")


def local_hour(ts, zone: str) -> Column:
    return F.floor(F.pmod(col(ts) + utc_offset(ts, zone), F.lit(DAY_S)) / 3600).cast("int")


def local_weekday(ts, zone: str) -> Column:
    """0 is Monday."""
    return F.pmod(F.floor((col(ts) + utc_offset(ts, zone)) / DAY_S) + 3, F.lit(7)).cast("int")


def local_day(ts, zone: str) -> Column:
    """The local date of an instant."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((col(ts) + utc_offset(ts, zone)) / DAY_S).cast("int"))


def relative_hour(t) -> Column:
    return F.pmod(F.floor(col(t) / 3600), F.lit(24)).cast("int")


def midnight(day, zone: str) -> Column:
    """Epoch seconds of a date's local midnight, by the offset that holds at that midnight."""
    utc = F.datediff(F.to_date(col(day)), F.lit("1970-01-01").cast("date")).cast("long") * DAY_S
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(utc), zone))


def relative_to_unix(day, rel, zone: str | None, fallback: int = 1_175_558_400) -> Column:
    """Local midnight of ``day`` plus seconds; unreadable days count from ``fallback``."""
    parsed = F.expr(f"try_cast({day} AS DATE)") if isinstance(day, str) else day.try_cast("date")
    return F.coalesce(midnight(parsed, zone or "UTC"), F.lit(fallback)) + col(rel).cast("long")


# -- randomness that does not depend on partitioning ----------------------------


def uniform(*keys) -> Column:
    """A number in [0, 1) from the md5 of the keys, the same in any run or engine."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4_294_967_296.0)


def pick(array, u) -> Column:
    """The element of an array at floor(u * size); null of an empty one."""
    return F.when(F.size(col(array)) > 0, F.element_at(col(array), (F.floor(col(u) * F.size(col(array))) + 1).cast("int")))


# -- scores -------------------------------------------------------------------


def relative_error(actual, wanted) -> Column:
    """Squared deviation relative to ``wanted``; absolute where that is not positive."""
    off = col(actual) - col(wanted)
    return F.when(col(wanted) > 0, (off / col(wanted)) * (off / col(wanted))).otherwise(off * off)


def overshoot(error, actual, wanted) -> Column:
    return F.when(col(actual) > col(wanted), col(error) * 2).otherwise(col(error))


def scale_penalty(distance_km, scale_km) -> Column:
    off = (col(distance_km) - col(scale_km)) / col(scale_km)
    return F.when(col(scale_km) > 0, off * off).otherwise(F.lit(0.0))


def relative_rmse(squared_error, n) -> Column:
    """Root of the mean error over pairs of ``n`` places; 0 for a single place."""
    pairs = col(n) * (col(n) - 1) / 2
    return F.when(col(n) > 1, F.sqrt(col(squared_error) / pairs)).otherwise(F.lit(0.0))


def detour_ratio(path, shortest) -> Column:
    return F.when(col(shortest) > 0, col(path) / col(shortest))


def efficiency(straight, path) -> Column:
    return F.when(col(path) > 0, col(straight) / col(path))


def blend(r, original, sampled) -> Column:
    """Whole seconds between an original and a sampled duration."""
    return ((1 - col(r)) * col(original) + col(r) * col(sampled)).cast("int")


def ramp_colour(x) -> Column:
    """Blue to green, to yellow, to red, at a third and two thirds of [0, 1], as #rrggbb."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))
    level = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")
    red, green, blue = level((t - 0.33) / 0.33), level(F.when(t < 0.66, t / 0.33).otherwise((1 - t) / 0.34)), level(1 - t / 0.33)
    return F.format_string("#%02x%02x%02x", red, green, blue)


def marker_radius(n) -> Column:
    return F.least(3 + F.log1p(col(n)), F.lit(10.0))


def flow_weight(n, most) -> Column:
    return 2 + 5 * col(n) / col(most)


def od_label(ox, oy, dx, dy) -> Column:
    return F.format_string("(%d,%d)→(%d,%d)", col(ox), col(oy), col(dx), col(dy))
