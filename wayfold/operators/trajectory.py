"""Statistics of trajectories: one pass over (user_id, trajectory_id, lat, lon, time, point_seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.core import haversine, local_hour, local_weekday, relative_hour, relative_to_unix

RELATIVE_BELOW = 100_000  # a user's times under this are seconds of a day


def with_steps(points: DataFrame) -> DataFrame:
    """``points`` with ``step``: metres from the point before, by time and sequence."""
    order = Window.partitionBy("user_id", "trajectory_id").orderBy("time", "point_seq")
    step = haversine(F.lag("lon").over(order), F.lag("lat").over(order), "lon", "lat")
    return points.withColumn("step", F.coalesce(step, F.lit(0.0)))


def trip_statistics(points: DataFrame, zone: str = "Europe/Rome") -> DataFrame:
    """Duration, origin and destination, lengths, start and its local clock, per trajectory.

    A single point has lengths 0.  If ``points`` has ``day_date`` and a user's times are all
    seconds of a day, starts are counted from that day's local midnight; without ``day_date``
    they keep their hour and have no weekday.
    """
    key = ["user_id", "trajectory_id"]
    when = F.struct("time", "point_seq")
    spot = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    seen = F.when(spot.isNotNull(), when)
    has_day = "day_date" in points.columns
    day = [F.min_by("day_date", "point_seq").alias("day_date")] if has_day else []
    # The window above leaves the rows dealt by the key, so this adds no exchange.
    stats = (
        with_steps(points)
        .groupBy(*key)
        .agg((F.max("time") - F.min("time")).alias("duration_seconds"), F.min_by(spot, seen).alias("o"), F.max_by(spot, seen).alias("d"), F.sum("step").alias("path_length_meters"), F.min("time").alias("first_time"), F.count("*").alias("n_points"), *day)
    )
    stats = stats.withColumn("latest_start", F.max("first_time").over(Window.partitionBy("user_id")))
    relative = F.col("latest_start") < RELATIVE_BELOW
    start = F.when(relative, relative_to_unix("day_date", "first_time", zone)).otherwise(F.col("first_time")) if has_day else F.col("first_time")
    clocked = F.lit(has_day) | ~relative
    return stats.select(
        *key, "duration_seconds",
        haversine(F.col("o.lon"), F.col("o.lat"), F.col("d.lon"), F.col("d.lat")).alias("od_distance_meters"),
        "path_length_meters",
        F.col("o.lat").alias("origin_lat"), F.col("o.lon").alias("origin_lon"), F.col("d.lat").alias("dest_lat"), F.col("d.lon").alias("dest_lon"),
        start.cast("long").alias("start_time"),
        F.when(clocked, local_hour(start, zone)).otherwise(relative_hour("first_time")).alias("start_hour"),
        F.when(clocked, local_weekday(start, zone)).alias("start_day_of_week"),
        "n_points",
    )


def integrity(stats: DataFrame, slack: float = 1e-6) -> DataFrame:
    """How many trips have a path shorter than their origin-destination distance."""
    return stats.agg(F.count("*").alias("trips"), F.count_if(F.col("path_length_meters") < F.col("od_distance_meters") - slack).alias("path_below_od"))


def global_trip_key(user, trajectory):
    return F.col(user) * 1_000_000 + F.col(trajectory)
