"""Cities that people can be moved to, and the zones of cities' clocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.core import GREAT_CIRCLE_M, col, haversine

# (name, latitude, longitude, radius in metres, zone); fixed values.
CITIES = (
    ("porto", 41.1494512, -8.6107884, 10_000.0, "Europe/Lisbon"),
    ("milan", 45.4642, 9.19, 15_000.0, "Europe/Rome"),
    ("waterdown", 43.331075, -79.895593, 2_400.0, None),
)
# Zones of all cities that are known by name (fixed values).
ZONES = (("milan", "Europe/Rome"), ("rome", "Europe/Rome"), ("porto", "Europe/Lisbon"), ("lisbon", "Europe/Lisbon"))


@dataclass(frozen=True)
class CityConfig:
    name: str
    lat: float
    lon: float
    radius_m: float


def city_config(name: str) -> CityConfig:
    """The centre and radius of a city; an unknown name is an error."""
    for city, lat, lon, radius, _ in CITIES:
        if city == name:
            return CityConfig(city, lat, lon, radius)
    raise ValueError(f"unknown city {name!r}; known: {', '.join(c[0] for c in CITIES)}")


def zone_of(name: str | None) -> str | None:
    """The zone of a city in any letter case; None (that is, UTC) for others."""
    return dict(ZONES).get(name.lower()) if name is not None else None


def zone_column(city) -> Column:
    """:func:`zone_of` of a column."""
    table = F.create_map(*[F.lit(x) for pair in ZONES for x in pair])
    return F.try_element_at(table, F.lower(col(city)))


def cities(spark: SparkSession) -> DataFrame:
    """(name, lat, lon, radius_m, zone): a few fixed rows."""
    return spark.createDataFrame(list(CITIES), "name string, lat double, lon double, radius_m double, zone string")


def inside(rows: DataFrame, city: CityConfig, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows within a city's radius of its centre: a box that the scan can filter by, then the distance."""
    reach = city.radius_m / 110_000.0
    box = F.col(lat).between(city.lat - reach, city.lat + reach)
    return rows.where(box).where(haversine(lon, lat, F.lit(city.lon), F.lit(city.lat), GREAT_CIRCLE_M) <= city.radius_m)
