"""GPS points to trips and individual mobility networks.

The segmentation follows published stop detection: a person who stays within ``spatial_m`` of
where they were for ``temporal_s`` or longer, or is silent that long, has ended a trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.core import haversine


def segment(points: DataFrame, temporal_s: int = 1200, spatial_m: float = 50.0) -> DataFrame:
    """Points (id, longitude, latitude, timestamp) with ``tid``, the number of their trip.

    A new trip begins after a silence longer than ``temporal_s``, and after a stop: a run of
    points, each within ``spatial_m`` of the one before, that lasts at least that long.
    """
    order = Window.partitionBy("id").orderBy("timestamp", "longitude", "latitude")
    p = points.withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(order)).withColumn("dm", haversine(F.lag("longitude").over(order), F.lag("latitude").over(order), "longitude", "latitude"))
    moving = F.col("dm").isNull() | (F.col("dm") > spatial_m)
    p = p.withColumn("run", F.sum(moving.cast("int")).over(order))
    run = Window.partitionBy("id", "run")
    p = p.withColumn("rested", F.max("timestamp").over(run) - F.min("timestamp").over(run) >= temporal_s)
    left_stop = F.lag("rested").over(order) & (F.lag("run").over(order) != F.col("run"))
    starts = F.coalesce(F.col("dt") > temporal_s, F.lit(True)) | F.coalesce(left_stop, F.lit(False))
    return p.withColumn("tid", F.sum(starts.cast("int")).over(order) - 1).drop("dt", "dm", "run", "rested")


def keep_active(segmented: DataFrame, more_than: int = 2) -> DataFrame:
    """Points of people with more than so many trips."""
    busy = segmented.groupBy("id").agg(F.countDistinct("tid").alias("n")).where(F.col("n") > more_than).select("id")
    return segmented.join(busy, "id", "left_semi")


def build_imn(segmented: DataFrame, cell_m: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """(locations, trips): trip ends clustered on cells, places numbered by support.

    locations (uid, loc_id, lon, lat, frequency); trips (uid, trip_seq, from_id, to_id, st, et).
    The most visited place is '0', the next '1', and so on; trips of one point are left out.
    """
    when = F.struct("timestamp")
    t = segmented.groupBy(F.col("id").alias("uid"), "tid").agg(F.min_by(F.struct("longitude", "latitude"), when).alias("a"), F.max_by(F.struct("longitude", "latitude"), when).alias("b"), F.min("timestamp").alias("st"), F.max("timestamp").alias("et"), F.count("*").alias("n")).where("n > 1")
    size = cell_m / 111_000.0
    cell = lambda e: F.concat_ws(":", F.floor(F.col(f"{e}.longitude") / size), F.floor(F.col(f"{e}.latitude") / size))
    t = t.withColumn("ca", cell("a")).withColumn("cb", cell("b"))
    ends = t.select("uid", F.explode(F.array(F.struct("ca", "a"), F.struct(F.col("cb").alias("ca"), F.col("b").alias("a")))).alias("e"))
    places = ends.groupBy("uid", F.col("e.ca").alias("cell")).agg(F.avg("e.a.longitude").alias("lon"), F.avg("e.a.latitude").alias("lat"), F.count("*").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("frequency"), "cell")) - 1
    places = places.withColumn("loc_id", rank.cast("string"))
    ids = places.select("uid", "cell", "loc_id")
    trips = t.join(ids.select("uid", F.col("cell").alias("ca"), F.col("loc_id").alias("from_id")), ["uid", "ca"]).join(ids.select("uid", F.col("cell").alias("cb"), F.col("loc_id").alias("to_id")), ["uid", "cb"])
    return places.select("uid", "loc_id", "lon", "lat", "frequency"), trips.select("uid", F.col("tid").alias("trip_seq"), "from_id", "to_id", "st", "et")


def sessions(events: DataFrame, key: str, time: str, gap: str = "20 minutes") -> DataFrame:
    """Sessions of events that are at most ``gap`` apart: (key, n, first, last)."""
    s = events.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return s.drop("session_window")
