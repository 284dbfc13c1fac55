"""Mobility tables derived from generic order, event and part tables, with integer arithmetic.

Any data set with these tables can drive the engine; the derivation gives every table that
the operators read: trajectory points, trips and places, features with tags, a road grid and
population cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = 30  # nodes on each side of the road grid
EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, trajectory_id, lat, lon, time, point_seq): order lines as GPS points."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_orderkey").alias("trajectory_id"),
        (F.lit(45.40) + (F.col("l_partkey") * 7919 % 1000) / F.lit(10000.0)).alias("lat"),
        (F.lit(9.10) + (F.col("l_suppkey") * 104729 % 1500) / F.lit(10000.0)).alias("lon"),
        (F.expr(EPOCH.format("o_orderdate")) + F.col("o_orderkey") % 86400 + F.col("l_linenumber") * 300).alias("time"),
        F.row_number().over(order).alias("point_seq"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, trip_seq, from_id, to_id, st, et): each event but the first ends a trip."""
    place = F.create_map(*[F.lit(x) for x in ("view", "0", "click", "1", "purchase", "2", "signup", "3", "error", "4")])
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    e = events.select(F.col("user_id").alias("uid"), "event_id", F.expr(EPOCH.format("ts")).alias("t"), place[F.col("event_type")].alias("loc"))
    order = Window.partitionBy("uid").orderBy("t", "event_id")
    e = e.withColumn("from_id", F.lag("loc").over(order)).withColumn("before", F.lag("t").over(order)).withColumn("n", F.row_number().over(order))
    ride = F.least(300 + F.col("event_id") % 1800, F.col("t") - F.col("before"))
    return e.where("n > 1").select("uid", (F.col("n") - 2).alias("trip_seq"), "from_id", F.col("loc").alias("to_id"), (F.col("t") - ride).alias("st"), F.col("t").alias("et"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, loc_id, lon, lat, frequency): the five places of every user with events."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid")).distinct()
    every = users.withColumn("loc_id", F.explode(F.array(*[F.lit(str(i)) for i in range(5)])))
    k = F.col("uid") * 31 + F.col("loc_id").cast("long") * 17
    return every.select("uid", "loc_id", (F.lit(9.10) + (k * 7919 % 1400) / F.lit(10000.0)).alias("lon"), (F.lit(45.40) + (k * 104729 % 900) / F.lit(10000.0)).alias("lat"), (1 + k % 13).alias("frequency"))


def poi_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, loc_id, poi): counts of ten activity classes near a place; some are all zero."""
    k = F.col("uid") * 31 + F.col("loc_id").cast("long") * 17
    vector = F.array(*[F.when(k % 6 == 0, 0).otherwise((k + i * 7 + k * i % 11) % 5).cast("double") for i in range(10)])
    return locations(spark, sf_dir).where(k % 7 != 0).select("uid", "loc_id", vector.alias("poi"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, tags, lon, lat): parts as map features with up to five tags."""
    p = F.col("p_partkey")
    values = {
        "amenity": ("cafe", "events_venue", "bench", "bank", "school", "parking", "clinic", "fuel"),
        "shop": ("bakery", "mall", "books", "unknown"),
        "leisure": ("park", "pitch", "maze"),
        "office": ("company", "government"),
        "landuse": ("residential", "commercial", "forest", "retail"),
    }
    chosen = lambda key, n: F.element_at(F.array(*[F.lit(v) for v in values[key]]), (n % len(values[key]) + 1).cast("int"))
    tags = F.create_map(
        F.lit("amenity"), F.when(p % 3 != 0, chosen("amenity", p)),
        F.lit("shop"), F.when(p % 4 == 0, chosen("shop", F.floor(p / 4))),
        F.lit("leisure"), F.when(p % 5 == 0, chosen("leisure", F.floor(p / 5))),
        F.lit("office"), F.when(p % 11 == 0, chosen("office", F.floor(p / 11))),
        F.lit("landuse"), F.when(p % 7 == 0, chosen("landuse", F.floor(p / 7))),
    )
    return table(spark, sf_dir, "part").select(
        p.alias("feature_id"),
        F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"),
        (F.lit(9.10) + (p * 7907 % 1450) / F.lit(10000.0)).alias("lon"),
        (F.lit(45.40) + (p * 104723 % 990) / F.lit(10000.0)).alias("lat"),
    )


def road_nodes(spark: SparkSession) -> DataFrame:
    """(node_id, x, y): a square grid of crossings."""
    i = F.col("id")
    return spark.range(GRID * GRID).select(i.alias("node_id"), (F.lit(9.10) + (i % GRID) * F.lit(0.005)).alias("x"), (F.lit(45.40) + F.floor(i / GRID) * F.lit(0.0034)).alias("y"))


def road_edges(spark: SparkSession) -> DataFrame:
    """(u, v, key, length, travel_time): neighbours in both directions, uneven lengths."""
    i = F.col("id")
    east = F.when(i % GRID < GRID - 1, i + 1)
    north = F.when(i < GRID * (GRID - 1), i + GRID)
    one = spark.range(GRID * GRID).select(i.alias("u"), F.explode(F.array(east, north)).alias("v")).where("v is not null")
    both = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    length = 300 + (F.col("u") * 37 + F.col("v") * 11) % 200
    return both.select("u", "v", F.lit(0).alias("key"), length.cast("double").alias("length"), (F.floor(length / 10) + 1).cast("double").alias("travel_time"))


def population_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, density, min_lon, min_lat, max_lon, max_lat): customers counted on a 5 x 5 raster."""
    n = F.col("c_nationkey")
    counts = table(spark, sf_dir, "customer").groupBy(n.alias("cell")).agg(F.count("*").cast("double").alias("density"))
    r, c = F.floor(F.col("cell") / 5), F.col("cell") % 5
    lon, lat = F.lit(9.10) + c * F.lit(0.03), F.lit(45.40) + (4 - r) * F.lit(0.0204)
    return counts.select(r.cast("int").alias("row"), c.cast("int").alias("col"), "density", lon.alias("min_lon"), lat.alias("min_lat"), (lon + 0.03).alias("max_lon"), (lat + 0.0204).alias("max_lat"))
