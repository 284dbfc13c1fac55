"""Writers of the engine's outputs; Spark makes the folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, gzip; ``append`` adds files."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def write_imns(locations: DataFrame, trips: DataFrame, path: str, mode: str = "append") -> None:
    """Mobility networks, one object a person, in the layout that the reader takes."""
    entry = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v))))
    places = locations.groupBy("uid").agg(entry("loc_id", F.array("lon", "lat")).alias("location_prototype"), entry("loc_id", F.struct(F.col("frequency").alias("loc_support"))).alias("location_features"))
    tid = F.format_string("%06d", F.col("trip_seq"))
    rides = trips.withColumn("tid", tid).groupBy("uid").agg(entry("tid", F.array("from_id", "to_id")).alias("traj_location_from_to"), entry("tid", F.array("st", "et")).alias("tid_se_times"))
    write_json_lines(places.join(rides, "uid"), path, mode)


def write_trajectories(points: DataFrame, path: str, city: str, form: str = "csv", buckets: int | None = None) -> None:
    """Synthetic points, a folder for each city and user.

    With ``buckets``, a folder for each city and hash bucket of users, for many people: the
    user is a column then, and a bucket's rows are written by one task.
    """
    rows = points.withColumn("city", F.lit(city))
    if buckets:
        rows = rows.withColumn("bucket", F.pmod(F.hash("user_id"), F.lit(buckets))).repartition(buckets, "bucket")
    out = rows.write.mode("overwrite").partitionBy("city", "bucket" if buckets else "user_id")
    out.option("header", True).csv(path) if form == "csv" else out.parquet(path)


def write_user_trajectories(segmented: DataFrame, path: str, more_than: int = 2) -> None:
    """Per-person JSON of trips, for people with more than so many."""
    t = segmented.groupBy(F.col("id").alias("uid"), "tid").agg(F.sort_array(F.collect_list(F.struct("timestamp", "longitude", "latitude"))).alias("p"), F.min("timestamp").alias("_start_time"))
    t = t.withColumn("object", F.transform("p", lambda x: F.array(x["longitude"], x["latitude"], x["timestamp"].cast("double"))))
    u = t.groupBy("uid").agg(F.count("*").cast("int").alias("num_trajectories"), F.map_from_entries(F.collect_list(F.struct(F.col("tid").cast("string"), F.struct("object", "_start_time")))).alias("trajectories"))
    u.where(F.col("num_trajectories") > more_than).withColumn("user", F.col("uid")).write.mode("overwrite").partitionBy("user").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header, for statistics, matrices and densities."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows of a small report (a summary, a coverage) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def _bars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bars): histograms (bin, n, lo, width) as counts of all bins and their edges."""
    h = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.first("lo").alias("lo"), F.first("width").alias("width"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.coalesce(F.get(F.filter("h", lambda x: x["bin"] == i), F.lit(0))["n"], F.lit(0)))
    edges = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("lo") + i * F.col("width"))
    return h.select(*keys, F.struct(counts.alias("hist"), edges.alias("bins")).alias("bars"))


def probability_reports(histograms: DataFrame, transitions: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(uid, duration_probs, transition_probs, trip_duration_probs) as JSON-ready maps.

    ``gaps``: the histogram of gaps between stays; a person without gaps has null there.
    """
    d = _bars(histograms, ["uid", "activity_label"]).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("activity_label", "bars"))).alias("duration_probs"))
    rows = transitions.groupBy("uid", "from_activity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("to_activity", "prob")))).alias("to"))
    t = rows.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("from_activity", "to"))).alias("transition_probs"))
    both = d.join(t, "uid", "full")
    if gaps is None:
        return both.withColumn("trip_duration_probs", F.lit(None).cast("struct<hist:array<bigint>,bins:array<double>>"))
    return both.join(_bars(gaps, ["uid"]).withColumnRenamed("bars", "trip_duration_probs"), "uid", "left")


def features_geojson(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """(value): rows as GeoJSON point features, one a line."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"))).alias("value"))
