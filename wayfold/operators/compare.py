"""Path metrics, and comparisons of original and synthetic distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.core import detour_ratio, efficiency

from .route import shortest_paths
from .spatial import nearest_any
from .stays import histogram
from .trajectory import trip_statistics


def path_metrics(points: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, synthetic: bool = False) -> DataFrame:
    """Straight, actual and shortest length, detour ratio and efficiency of trips of two points or more.

    Synthetic trips follow shortest paths, so theirs is their own length.  Otherwise the ends
    go to their nearest nodes; where no path joins these, the ratio is null.
    """
    stats = trip_statistics(points).where("n_points >= 2")
    base = stats.select("user_id", "trajectory_id", F.col("od_distance_meters").alias("straight_line_distance"), F.col("path_length_meters").alias("actual_path_length"), "origin_lat", "origin_lon", "dest_lat", "dest_lon")
    if synthetic:
        base = base.withColumn("shortest_path_length", F.col("actual_path_length"))
    else:
        ends = base.select("origin_lon", "origin_lat").union(base.select("dest_lon", "dest_lat")).distinct().toDF("lon", "lat")
        placed = nearest_any(ends, ["lon", "lat"], nodes).select("lon", "lat", "node_id")
        o = placed.select(F.col("lon").alias("origin_lon"), F.col("lat").alias("origin_lat"), F.col("node_id").alias("o"))
        d = placed.select(F.col("lon").alias("dest_lon"), F.col("lat").alias("dest_lat"), F.col("node_id").alias("d"))
        base = base.join(o, ["origin_lon", "origin_lat"], "left").join(d, ["dest_lon", "dest_lat"], "left")
        paths = shortest_paths(base, edges, "length").select("o", "d", F.col("cost").alias("shortest_path_length"))
        base = base.join(paths, ["o", "d"], "left")
    return base.select("user_id", "trajectory_id", "straight_line_distance", "actual_path_length", "shortest_path_length", detour_ratio("actual_path_length", "shortest_path_length").alias("detour_ratio"), efficiency("straight_line_distance", "actual_path_length").alias("efficiency"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[f(c).alias(f"{c}_{n}") for c in ("detour_ratio", "efficiency") for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("n", F.count))])


def shared_histogram(left: DataFrame, right: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts of both sets over bins of their common range (10 bins if it is a point)."""
    both = left.select(F.lit("original").alias("side"), F.col(value).cast("double").alias("v")).union(right.select(F.lit("synthetic").alias("side"), F.col(value).cast("double").alias("v"))).where("v is not null")
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.when(flat, 10).otherwise(bins).alias("bins"))
    at = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))).cast("int")
    return both.crossJoin(F.broadcast(ends)).groupBy("side", at.alias("bin")).agg(F.count("*").alias("n"))


def fixed_range_histogram(values: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Bins of a given range; what lies outside is dropped and counted as bin -1."""
    v = F.col(value)
    at = F.when((v < lo) | (v > hi), -1).otherwise(F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins))).cast("int")
    return values.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 ranges of the middle half, and counts of what lies outside."""
    q = values.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    v, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr)
    j = values.join(q, keys) if keys else values.crossJoin(F.broadcast(q))
    return j.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outside"))


def hour_counts(stats: DataFrame) -> DataFrame:
    """Trips by start hour, all 24."""
    spine = stats.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(stats.groupBy(F.col("start_hour").alias("hour")).agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def weekday_counts(stats: DataFrame) -> DataFrame:
    """Trips by weekday, Monday 0 to Sunday 6, missing days 0."""
    spine = stats.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    return spine.join(stats.groupBy(F.col("start_day_of_week").alias("weekday")).agg(F.count("*").alias("n")), "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_midpoints(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A histogram as the samples it stands for: each bin's middle, as often as it counts."""
    h = histogram(values, keys, value)
    return h.select(*keys, F.explode(F.array_repeat(F.col("lo") + (F.col("bin") + 0.5) * F.col("width"), F.col("n").cast("int"))).alias("sample"))
