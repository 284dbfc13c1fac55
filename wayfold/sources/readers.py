"""Readers of the engine's input files.  Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "id BIGINT, longitude DOUBLE, latitude DOUBLE, timestamp BIGINT"
_NETWORK = "location_prototype MAP<STRING,ARRAY<DOUBLE>>, location_features MAP<STRING,STRUCT<loc_support:BIGINT>>, traj_location_from_to MAP<STRING,ARRAY<STRING>>, tid_se_times MAP<STRING,ARRAY<BIGINT>>"
IMN = f"uid BIGINT, {_NETWORK}"
POI = "uid BIGINT, poi_classes ARRAY<STRING>, poi_freq MAP<STRING,ARRAY<DOUBLE>>"
TRAJECTORY = "trajectory_id BIGINT, lat DOUBLE, lon DOUBLE, time DOUBLE, day_date STRING"
_GPS = "trajectories MAP<STRING,STRUCT<object:ARRAY<ARRAY<DOUBLE>>,_start_time:BIGINT>>"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """GPS points; rows without an id, place or time are dropped."""
    return spark.read.schema(POINTS).option("header", True).csv(path).dropna()


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line with its order in the files; blank and broken lines are skipped."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 1)
    ordered = lines.select("value", F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("n")).alias("line"))
    return ordered.withColumn("j", F.from_json("value", schema)).select("line", "j.*").where("uid is not null")


def _last_of_each(records: DataFrame) -> DataFrame:
    """A later record of a person replaces earlier ones."""
    last = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("line")))
    return records.withColumn("rn", last).where("rn = 1").drop("rn", "line")


def read_imns(spark: SparkSession, path: str) -> DataFrame:
    """Mobility networks; objects with nothing but a person's id are skipped."""
    got = _records(spark, path, IMN).where("location_prototype is not null or traj_location_from_to is not null")
    return _last_of_each(got)


def read_old_imns(spark: SparkSession, path: str, period: str = "03-04") -> DataFrame:
    """The older layout, nested under a period; people without that period are skipped."""
    field = T.StructType([T.StructField("uid", T.LongType()), T.StructField(period, T.StructType.fromDDL(_NETWORK))])
    got = _records(spark, path, field.simpleString() if period.isidentifier() else field)
    return _last_of_each(got.where(F.col(f"`{period}`").isNotNull()).select("line", "uid", F.col(f"`{period}`").alias("p")).select("line", "uid", "p.*"))


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    return _last_of_each(_records(spark, path, POI))


def imn_locations(imns: DataFrame) -> DataFrame:
    """(uid, loc_ord, loc_id, lon, lat, frequency): places in the order of the file."""
    spread = imns.select("uid", "location_features", F.posexplode(F.map_entries("location_prototype")).alias("loc_ord", "e"))
    return spread.select("uid", "loc_ord", F.col("e.key").alias("loc_id"), F.col("e.value")[0].alias("lon"), F.col("e.value")[1].alias("lat"), F.coalesce(F.col("location_features")[F.col("e.key")]["loc_support"], F.lit(0)).alias("frequency"))


def imn_trips(imns: DataFrame) -> DataFrame:
    """(uid, trip_seq, from_id, to_id, st, et) in the order of the file; trips without times have null times."""
    spread = imns.select("uid", "tid_se_times", F.posexplode(F.map_entries("traj_location_from_to")).alias("trip_seq", "e"))
    times = F.col("tid_se_times")[F.col("e.key")]
    return spread.select("uid", "trip_seq", F.col("e.value")[0].alias("from_id"), F.col("e.value")[1].alias("to_id"), times[0].alias("st"), times[1].alias("et"))


def poi_vectors(pois: DataFrame) -> DataFrame:
    return pois.select("uid", F.explode("poi_freq").alias("loc_id", "poi"))


def read_trajectory_csv(spark: SparkSession, folder: str, glob: str = "user_*_trajectory.csv") -> DataFrame:
    """(user_id, trajectory_id, lat, lon, time, day_date, point_seq) of all matching files.

    The user is the number in a file's name.  Each file is read by its own header: columns may
    come in any order and number, ``day_date`` may be missing (null); files without a user or
    one of the other columns are skipped.  A file is one person's, so it is one row at first.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    uid = F.regexp_extract(F.col("_metadata.file_name"), r"user_(\d+)_", 1).try_cast("long")
    files = raw.select(uid.alias("user_id"), F.split("value", r"\r?\n").alias("lines")).where("user_id is not null")
    bare = lambda x: F.trim(F.regexp_replace(x, '"', ""))
    files = files.withColumn("header", F.transform(F.split(F.col("lines")[0], ","), bare))
    needed = ("trajectory_id", "lat", "lon", "time")
    for name in needed:
        files = files.where(F.array_contains("header", name))
    rows = files.select("user_id", "header", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("point_seq", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("f", F.split("line", ","))
    at = lambda name: F.when(F.array_contains("header", name), bare(F.try_element_at("f", F.array_position("header", name).cast("int"))))
    typed = [at(name).try_cast(kind).alias(name) for name, kind in (x.split() for x in TRAJECTORY.split(", "))]
    return rows.select("user_id", *typed, F.col("point_seq").cast("long").alias("point_seq"))


def read_trajectory_json(spark: SparkSession, folder: str, glob: str = "user_*_trajectories.json") -> DataFrame:
    """The same of JSON files: points [lon, lat, time]; trajectories without points are skipped."""
    raw = spark.read.schema(_GPS).option("multiLine", True).option("pathGlobFilter", glob).json(folder)
    uid = F.regexp_extract(F.col("_metadata.file_name"), r"user_(\d+)_", 1).try_cast("long")
    trips = raw.select(uid.alias("user_id"), F.explode("trajectories").alias("tid", "t")).where("t.object is not null and user_id is not null")
    pts = trips.select("user_id", F.col("tid").try_cast("long").alias("trajectory_id"), F.posexplode("t.object").alias("point_seq", "p"))
    return pts.select("user_id", "trajectory_id", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"), F.col("p")[2].alias("time"), F.col("point_seq").cast("long").alias("point_seq"))


def read_gps_trips(spark: SparkSession, folder: str, uid: int | None = None) -> DataFrame:
    """(user_id, trajectory_id, start_time, points) of original GPS files, of one person or all.

    Only that person's file is listed; without one there are no rows.
    """
    raw = spark.read.schema(_GPS).option("multiLine", True).option("pathGlobFilter", f"user_{'*' if uid is None else uid}_trajectories.json").json(folder)
    who = F.regexp_extract(F.col("_metadata.file_name"), r"user_(\d+)_", 1).try_cast("long")
    trips = raw.select(who.alias("user_id"), F.explode("trajectories").alias("tid", "t")).where("user_id is not null")
    return trips.select("user_id", F.col("tid").try_cast("long").alias("trajectory_id"), F.col("t._start_time").alias("start_time"), F.col("t.object").alias("points"))


def _first_users(points: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return points
    return points.join(points.select("user_id").distinct().orderBy("user_id").limit(limit), "user_id", "left_semi")


def by_priority(*sources: DataFrame) -> DataFrame:
    """Each user's rows from the first of ``sources`` that has any; columns that one lacks are null."""
    both = None
    for k, points in enumerate(sources):
        own = points.withColumn("prio", F.lit(k))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    best = both.groupBy("user_id").agg(F.min("prio").alias("prio"))
    return both.join(best, ["user_id", "prio"], "left_semi").drop("prio")


def merge_trajectories(csv: DataFrame, json: DataFrame, limit_users: int | None = None) -> DataFrame:
    """Both formats, JSON before CSV for a user that has both; of each format at most so many users, by id.

    ``day_date`` stays, null where a format has none.
    """
    return by_priority(_first_users(json, limit_users), _first_users(csv, limit_users))


def load_trajectories(spark: SparkSession, folder: str, city: str = "porto", limit_users: int | None = None) -> DataFrame:
    """All trajectories of a folder: the city's CSV files, or any if it has none, and JSON files."""
    named = read_trajectory_csv(spark, folder, f"user_*_{city}_trajectory.csv")
    csv = named if named.limit(1).count() else read_trajectory_csv(spark, folder)
    return merge_trajectories(csv, read_trajectory_json(spark, folder), limit_users)


def matched_originals(originals: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Originals of the users that the synthetic side has."""
    return originals.join(synthetic.select("user_id").distinct(), "user_id", "left_semi")


def load_matched_originals(spark: SparkSession, folder: str, synthetic: DataFrame, city: str = "porto") -> DataFrame:
    """Originals of the synthetic side's users: JSON, else the city's CSV, else another CSV."""
    plain = read_trajectory_csv(spark, folder, "user_[0-9]*_trajectory.csv")
    sources = [read_trajectory_json(spark, folder), read_trajectory_csv(spark, folder, f"user_*_{city}_trajectory.csv"), plain]
    users = synthetic.select("user_id").distinct()
    return by_priority(*[s.join(users, "user_id", "left_semi") for s in sources])


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file; travel time from length and speed where it is missing."""
    doc = spark.read.text(path, wholetext=True)
    keys = F.expr(r"regexp_extract_all(value, '<key[^>]*>', 0)")
    named = doc.select("value", F.map_from_entries(F.transform(keys, lambda k: F.struct(F.regexp_extract(k, r'attr\.name="([^"]*)"', 1), F.regexp_extract(k, r'\bid="([^"]*)"', 1)))).alias("k"))
    data = lambda x, name: F.call_function("regexp_extract", x, F.concat(F.lit('key="'), F.coalesce(F.col("k")[name], F.lit("none")), F.lit('">([^<]*)<')), F.lit(1))
    body = named.select("k", F.explode(F.expr(r"regexp_extract_all(value, '(?s)<node .*?</node>', 0)")).alias("x"))
    attr = lambda x, name: F.regexp_extract(x, rf'\b{name}="([^"]*)"', 1)
    nodes = body.select(attr("x", "id").cast("long").alias("node_id"), data(F.col("x"), "x").try_cast("double").alias("x"), data(F.col("x"), "y").try_cast("double").alias("y"))
    lines = named.select("k", F.explode(F.expr(r"regexp_extract_all(value, '(?s)<edge .*?</edge>', 0)")).alias("x"))
    edges = lines.select(attr("x", "source").cast("long").alias("u"), attr("x", "target").cast("long").alias("v"), F.coalesce(attr("x", "id").try_cast("int"), F.lit(0)).alias("key"), data(F.col("x"), "length").try_cast("double").alias("length"), data(F.col("x"), "speed_kph").try_cast("double").alias("kph"), data(F.col("x"), "travel_time").try_cast("double").alias("tt"))
    return nodes, edges.select("u", "v", "key", "length", F.coalesce("tt", F.col("length") / (F.coalesce("kph", F.lit(30.0)) / 3.6)).alias("travel_time"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, tags, lon, lat, min_lon, min_lat, src_ord) of GeoJSON points and polygons.

    lon and lat are the middle of the bounding box's corners for polygons.
    """
    schema = "features ARRAY<STRUCT<id:STRING,properties:MAP<STRING,STRING>,geometry:STRUCT<type:STRING,coordinates:STRING>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("src_ord", "f"))
    numbers = F.transform(F.expr(r"regexp_extract_all(f.geometry.coordinates, '-?[0-9.]+(?:[eE][-+]?[0-9]+)?', 0)"), lambda x: x.try_cast("double"))
    n = raw.withColumn("n", numbers)
    lons, lats = F.filter("n", lambda x, i: i % 2 == 0), F.filter("n", lambda x, i: i % 2 == 1)
    return n.select(F.coalesce(F.regexp_extract("f.id", r"(\d+)$", 1).try_cast("long"), F.col("src_ord").cast("long")).alias("feature_id"), F.map_filter("f.properties", lambda k, v: v.isNotNull()).alias("tags"), ((F.array_min(lons) + F.array_max(lons)) / 2).alias("lon"), ((F.array_min(lats) + F.array_max(lats)) / 2).alias("lat"), F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"), "src_ord")
