"""Tables behind maps and timeline charts: what a plotting tool would draw, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.core import cell_corner, col, local_day, ramp_colour

from .grid import CELL_M

# Colours of activities on maps, and on timelines where they differ (fixed values).
MAP_COLOURS = (
    ("home", "darkblue"), ("work", "orange"), ("eat", "green"), ("utility", "purple"), ("transit", "red"), ("unknown", "gray"),
    ("school", "yellow"), ("shop", "pink"), ("leisure", "lightgreen"), ("health", "lightcoral"), ("admin", "lightblue"), ("finance", "gold"),
)
TIMELINE_HOME = "skyblue"
OTHER_COLOUR = "black"
LEAST_OPACITY = 0.45


def colour(activity, on_timeline: bool = False) -> Column:
    """The colour of an activity in any letter case; null reads as unknown."""
    pairs = [(a, TIMELINE_HOME if on_timeline and a == "home" else c) for a, c in MAP_COLOURS]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(col(activity), F.lit("unknown")))), F.lit(OTHER_COLOUR))


def opacity(i, n) -> Column:
    """Of leg ``i`` of ``n``, from 1 down to the least."""
    fading = F.greatest(F.lit(LEAST_OPACITY), 1 - col(i) * (1 - LEAST_OPACITY) / (col(n) - 1))
    return F.when(col(n) == 1, 1.0).otherwise(fading)


def origin_points(stats: DataFrame) -> DataFrame:
    """(origin_lat, origin_lon, n): trips by their exact place of origin."""
    return stats.groupBy("origin_lat", "origin_lon").agg(F.count("*").alias("n"))


def centre(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: the mean place."""
    return rows.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))


def flow_centre(pairs: DataFrame) -> DataFrame:
    """One row: the middle of the mean origin and the mean destination."""
    half = lambda a, b: (F.avg(a) + F.avg(b)) / 2
    return pairs.agg(half("origin_lat", "dest_lat").alias("lat"), half("origin_lon", "dest_lon").alias("lon"))


def normalised(counts: DataFrame, count: str) -> DataFrame:
    """``counts`` with ``share``: from 0 for the least count to 1 for the most, 1 if all are equal."""
    ends = counts.agg(F.min(count).alias("least"), F.max(count).alias("most"))
    share = F.when(F.col("most") > F.col("least"), (F.col(count) - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(1.0)
    return counts.crossJoin(F.broadcast(ends)).withColumn("share", share).drop("least", "most")  # one row


def density_cells(celled: DataFrame, size: float = CELL_M) -> DataFrame:
    """Cells of origins with their borders, count, share and colour."""
    keys = [F.col("origin_cell_x").alias("cell_x"), F.col("origin_cell_y").alias("cell_y"), "ref_lon", "ref_lat"]
    counts = normalised(celled.groupBy(*keys).agg(F.count("*").alias("n")), "n")
    west, south = cell_corner("cell_x", "cell_y", "ref_lon", "ref_lat", size)
    east, north = cell_corner(F.col("cell_x") + 1, F.col("cell_y") + 1, "ref_lon", "ref_lat", size)
    return counts.select("cell_x", "cell_y", "n", "share", ramp_colour("share").alias("colour"), west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"))


def trips_of_days(trips: DataFrame, zone: str) -> DataFrame:
    """GPS trips (…, start_time) with ``day_date``, the local date of the start; without a start: none."""
    return trips.where(F.coalesce(F.col("start_time"), F.lit(0)) != 0).withColumn("day_date", local_day("start_time", zone))


def stay_places(days: DataFrame, locations: DataFrame) -> DataFrame:
    """Stays of days with the place they were at (lat, lon) and their colour; unknown places are left out."""
    at = locations.select("uid", F.col("loc_id").alias("location_id"), "lon", "lat")
    order = Window.partitionBy("uid", "day_date").orderBy("stay_seq", "start_time")
    placed = days.withColumn("idx", F.row_number().over(order) - 1).join(at, ["uid", "location_id"])
    return placed.select("uid", "day_date", "idx", "location_id", "activity_label", "duration", "lat", "lon", colour("activity_label").alias("colour"))


def markers(placed: DataFrame, key: str) -> DataFrame:
    """(uid, day_date, idx, ``key``, activity_label, …): markers; of home and work one a place and person.

    Such a marker is the first one by day and stay; it stands for all days.
    """
    shared = F.lower("activity_label").isin("home", "work")
    nth = F.row_number().over(Window.partitionBy("uid", key, shared).orderBy("day_date", "idx"))
    return placed.withColumn("nth", nth).where(~shared | (F.col("nth") == 1)).drop("nth").withColumn("on_all_days", F.lower("activity_label").isin("home", "work"))


def straight_legs(placed: DataFrame) -> DataFrame:
    """Lines between consecutive stays of a day that both have a place."""
    order = Window.partitionBy("uid", "day_date").orderBy("idx")
    ahead = lambda c: F.lead(c).over(order)
    legs = placed.withColumn("next_idx", ahead("idx")).withColumn("to_lat", ahead("lat")).withColumn("to_lon", ahead("lon"))
    return legs.where(F.col("next_idx") == F.col("idx") + 1).select("uid", "day_date", F.col("idx").alias("leg"), "lat", "lon", "to_lat", "to_lon")


def source_day_lines(gps: DataFrame, placed: DataFrame) -> DataFrame:
    """(uid, day_date, kind, lines): how many lines each day of a source map has, of GPS trips or else of straight legs."""
    own = gps.groupBy("uid", "day_date").agg(F.count("*").alias("lines")).withColumn("kind", F.lit("gps"))
    made = straight_legs(placed).groupBy("uid", "day_date").agg(F.count("*").alias("lines")).withColumn("kind", F.lit("straight"))
    rest = made.join(own.select("uid", "day_date"), ["uid", "day_date"], "left_anti")
    return own.unionByName(rest).select("uid", "day_date", "kind", "lines")


def leg_lines(legs: DataFrame) -> DataFrame:
    """Legs of a target day (uid, day_date, r, stay_seq) with their number ``i`` and ``opacity``."""
    key = Window.partitionBy("uid", "day_date", "r")
    numbered = legs.withColumn("i", F.row_number().over(key.orderBy("stay_seq")) - 1).withColumn("n", F.count("*").over(key))
    return numbered.withColumn("opacity", opacity("i", "n"))


def target_centre(points: DataFrame) -> DataFrame:
    """(user_id, lat, lon): the middle point of each person's first day."""
    first = points.withColumn("first_day", F.min("day_date").over(Window.partitionBy("user_id"))).where("day_date = first_day")
    key = Window.partitionBy("user_id")
    numbered = first.withColumn("i", F.row_number().over(key.orderBy("trajectory_id", "point_seq")) - 1).withColumn("n", F.count("*").over(key))
    return numbered.where(F.col("i") == F.floor(F.col("n") / 2)).select("user_id", "lat", "lon")


def timeline_bars(days: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(uid, day_date, lane, act, st, et, colour, outlined): bars of original and synthetic days.

    Lane 0 is the original, whose anchor is outlined, the levels follow in order.  ``days``:
    (uid, day_date, stays, anchor_seq) of :func:`wayfold.operators.timeline.day_bundles`;
    ``synthetic``: (uid, day_date, r, stays).
    """
    own = days.select("uid", "day_date", F.lit(0).alias("lane"), "anchor_seq", F.explode("stays").alias("s"))
    own = own.select("uid", "day_date", "lane", "s.act", "s.st", "s.et", (F.col("s.stay_seq") == F.col("anchor_seq")).alias("outlined"))
    lane = F.dense_rank().over(Window.partitionBy("uid", "day_date").orderBy("r"))
    made = synthetic.withColumn("lane", lane).select("uid", "day_date", "lane", F.explode("stays").alias("s")).select("uid", "day_date", "lane", "s.act", "s.st", "s.et", F.lit(False).alias("outlined"))
    return own.union(made).withColumn("colour", colour("act", on_timeline=True))


def split_view(left: str, right: str, title: str) -> str:
    """A page that shows two maps side by side."""
    frame = lambda src: f'<iframe src="{src}" style="flex:1;border:0;height:100vh"></iframe>'
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body style="margin:0;display:flex">{frame(left)}{frame(right)}</body></html>'
