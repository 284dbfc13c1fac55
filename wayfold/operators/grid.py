"""Grid aggregates of trips: reference origin, origin-destination matrix, densities, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.core import cell_x, cell_y

CELL_M = 500.0


def reference_origin(stats: DataFrame) -> DataFrame:
    """One row: the least latitude and longitude of all origins and destinations."""
    return stats.agg(F.least(F.min("origin_lat"), F.min("dest_lat")).alias("ref_lat"), F.least(F.min("origin_lon"), F.min("dest_lon")).alias("ref_lon"))


def with_cells(stats: DataFrame, size: float = CELL_M) -> DataFrame:
    """``stats`` with origin and destination cells; the reference is one broadcast row."""
    j = stats.crossJoin(F.broadcast(reference_origin(stats)))
    for p, side in (("origin", "origin"), ("dest", "dest")):
        j = j.withColumn(f"{side}_cell_x", cell_x(f"{p}_lon", "ref_lon", "ref_lat", size)).withColumn(f"{side}_cell_y", cell_y(f"{p}_lat", "ref_lat", size))
    return j


def od_matrix(celled: DataFrame) -> DataFrame:
    """Trips between cells, with the coordinates of the first trip of each pair."""
    first = F.min_by(F.struct("origin_lat", "origin_lon", "dest_lat", "dest_lon"), F.struct("user_id", "trajectory_id"))
    out = celled.groupBy("origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y").agg(F.count("*").alias("trip_count"), first.alias("c"), F.first("ref_lat").alias("ref_lat"), F.first("ref_lon").alias("ref_lon"))
    return out.select("origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y", "trip_count", "c.*", "ref_lat", "ref_lon")


def density(celled: DataFrame, side: str) -> DataFrame:
    """Trips that start (``origin``) or end (``dest``) in each cell, most first."""
    name = "origin_count" if side == "origin" else "dest_count"
    out = celled.groupBy(F.col(f"{side}_cell_x").alias("cell_x"), F.col(f"{side}_cell_y").alias("cell_y")).agg(F.count("*").alias(name))
    return out.orderBy(F.desc(name), "cell_x", "cell_y")


def top_pairs(matrix: DataFrame, n: int = 20) -> DataFrame:
    keys = ["origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y"]
    return matrix.orderBy(F.desc("trip_count"), *keys).limit(n)


def coverage(stats: DataFrame) -> DataFrame:
    """Bounding box of all ends of trips, its sides in km and its area."""
    out = stats.agg(
        F.least(F.min("origin_lat"), F.min("dest_lat")).alias("min_lat"), F.greatest(F.max("origin_lat"), F.max("dest_lat")).alias("max_lat"),
        F.least(F.min("origin_lon"), F.min("dest_lon")).alias("min_lon"), F.greatest(F.max("origin_lon"), F.max("dest_lon")).alias("max_lon"),
        ((F.sum("origin_lat") + F.sum("dest_lat")) / (F.count("origin_lat") + F.count("dest_lat"))).alias("mid"),
    )
    lat_km = (F.col("max_lat") - F.col("min_lat")) * 111.0
    lon_km = (F.col("max_lon") - F.col("min_lon")) * 111.0 * F.cos(F.radians("mid"))
    return out.select("min_lat", "max_lat", "min_lon", "max_lon", lat_km.alias("lat_range_km"), lon_km.alias("lon_range_km"), (lat_km * lon_km).alias("area_km2"))


def summary(celled: DataFrame) -> DataFrame:
    """One row of counts and moments of durations and lengths."""
    aggs = [F.countDistinct("user_id").alias("users"), F.count("*").alias("trips")]
    for c, name in (("duration_seconds", "duration"), ("od_distance_meters", "od"), ("path_length_meters", "path")):
        aggs += [F.avg(c).alias(f"{name}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{name}_median"), F.stddev_samp(c).alias(f"{name}_std"), F.min(c).cast("double").alias(f"{name}_min"), F.max(c).cast("double").alias(f"{name}_max")]
    aggs += [F.countDistinct("origin_cell_x", "origin_cell_y").alias("origin_cells"), F.countDistinct("dest_cell_x", "dest_cell_y").alias("dest_cells"), F.countDistinct("origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y").alias("od_pairs")]
    return celled.agg(*aggs).withColumn("trips_per_user", F.col("trips") / F.col("users"))
