"""Spatial joins, tag classes, pools and population, as equi joins on cells.

A range join plans as a nested loop; here both sides get a cell of the search radius, one side
visits the neighbouring cells, and the exact distance is checked behind an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.core import GREAT_CIRCLE_M, haversine, uniform

from .stays import CLASSES
from .steps import settle

BROADCAST_NODES = 1_000_000  # nodes (three numbers each) that a step may broadcast

# Map tags of each activity class, and the order in which a feature's keys are tried (fixed values).
TAG_VALUES = {
    ("transit", "amenity"): "parking taxi fuel parking_entrance parking_exit parking_access car_rental bicycle_rental bus_station bicycle_parking motorcycle_parking ferry_terminal kick-scooter_parking motorcycle_rental taxi_rank",
    ("transit", "public_transport"): "station stop_position platform",
    ("transit", "railway"): "station halt stop tram_stop",
    ("transit", "highway"): "bus_stop bus_station",
    ("transit", "aeroway"): "aerodrome terminal",
    ("health", "amenity"): "pharmacy clinic hospital dentist doctors veterinary nursing_home health_post",
    ("admin", "amenity"): "post_office police fire_station townhall courthouse waste_disposal social_facility shelter community_centre public_bookcase prison archive mortuary public_building crematorium payment_centre meeting_room reception_desk group_home dormitory",
    ("admin", "office"): "government administrative",
    ("finance", "amenity"): "bank atm bureau_de_change money_transfer",
    ("eat", "amenity"): "restaurant cafe fast_food pub bar ice_cream biergarten food_court canteen",
    ("utility", "amenity"): "telephone recycling drinking_water toilets vending_machine charging_station compressed_air sanitary_dump_station water_point bicycle_repair_station vacuum_cleaner parcel_locker",
    ("utility", "man_made"): "water_tower wastewater_plant works",
    ("utility", "power"): "substation plant",
    ("school", "amenity"): "library school kindergarten college university music_school driving_school childcare research_institute language_school",
    ("leisure", "amenity"): "cinema theatre nightclub studio events_venue gambling public_bath watering_place auditorium",
    ("leisure", "leisure"): "park playground pitch sports_centre stadium swimming_pool",
    ("shop", "amenity"): "marketplace mall",
    ("shop", "shop"): "supermarket convenience mall department_store bakery beverages alcohol butcher greengrocer kiosk clothes shoes electronics hardware doityourself furniture books sports outdoor variety_store stationery beauty chemist jewelry gift",
}
KEY_ORDER = ("amenity", "public_transport", "railway", "highway", "aeroway", "office", "man_made", "power", "leisure", "shop")


def tag_classes(spark: SparkSession) -> DataFrame:
    """(key, value, activity, priority): a small fixed table."""
    rows = [(key, value, activity, KEY_ORDER.index(key)) for (activity, key), values in TAG_VALUES.items() for value in values.split()]
    return spark.createDataFrame(rows, "key string, value string, activity string, priority int")


def classify(features: DataFrame, unmatched: str | None = "other") -> DataFrame:
    """Features with ``activity``: of the first of their keys (in order) with a known value.

    ``unmatched`` names what no tag decides; None leaves such features out.
    """
    spread = features.select("feature_id", F.explode("tags").alias("key", "value"))
    hits = spread.join(F.broadcast(tag_classes(features.sparkSession)), ["key", "value"])  # a fixed table of a few hundred rows
    best = hits.groupBy("feature_id").agg(F.min_by("activity", "priority").alias("activity"))
    if unmatched is None:
        return features.join(best, "feature_id")
    return features.join(best, "feature_id", "left").withColumn("activity", F.coalesce("activity", F.lit(unmatched)))


def _cell_x(lon, cy, radius: float) -> Column:
    """Cell of ``lon`` in the row ``cy``: as wide as the radius at the far edge of the rows next to it."""
    degree = radius / 111_000.0
    edge = (F.greatest(F.abs(cy), F.abs(cy + 1)) + 1) * degree
    return F.when(edge < 89.0, F.floor(lon / (degree / F.cos(F.radians(edge))))).otherwise(F.lit(0))  # by a pole: one cell


def within_radius(left: DataFrame, right: DataFrame, radius: float, earth: float = GREAT_CIRCLE_M) -> DataFrame:
    """Pairs of ``left`` (lon, lat, ...) and ``right`` (rlon, rlat, ...) within ``radius`` metres, and their distance ``dist``.

    Cells are at least the radius wide at every latitude: each row of cells has its own width.
    ``right`` visits its nine neighbouring cells, so it should be the smaller side.
    """
    wide = radius * 1.02  # a degree is a little shorter than 111 km in places
    row = lambda lat: F.floor(F.col(lat) / (wide / 111_000.0))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = right.withColumn("dx", F.explode(near)).withColumn("cy", F.explode(F.transform(near, lambda i: row("rlat") + i)))
    spread = spread.withColumn("cx", _cell_x(F.col("rlon"), F.col("cy"), wide) + F.col("dx")).drop("dx")
    keyed = left.withColumn("cy", row("lat")).withColumn("cx", _cell_x(F.col("lon"), F.col("cy"), wide))
    joined = keyed.join(spread, ["cx", "cy"]).drop("cx", "cy")
    return joined.withColumn("dist", haversine("lon", "lat", "rlon", "rlat", earth)).where(F.col("dist") <= radius)


def _closest(pairs: DataFrame, key: list[str]) -> DataFrame:
    best = F.min_by(F.struct("node_id", "dist"), F.struct(F.round("dist", 6), "node_id"))
    return pairs.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.node_id").alias("node_id"), F.col("b.dist").alias("dist"))


def _other(pairs: DataFrame, other_than: str | None) -> DataFrame:
    return pairs.where(F.col("node_id") != F.col(other_than)) if other_than else pairs


def nearest(left: DataFrame, key: list[str], nodes: DataFrame, radius: float, other_than: str | None = None) -> DataFrame:
    """Each left row's nearest node within ``radius`` (least id of equals); none: no row.

    ``other_than``: a column of ``left`` with a node that does not count.
    """
    return _closest(_other(within_radius(left, nodes.select("node_id", F.col("x").alias("rlon"), F.col("y").alias("rlat")), radius), other_than), key)


def nearest_any(left: DataFrame, key: list[str], nodes: DataFrame, first_radius: float = 250.0, rounds: int = 12, other_than: str | None = None) -> DataFrame:
    """Nearest node without a bound: rings of doubling radius, then all nodes for what is still open."""
    found, radius, left = None, first_radius, settle(left, "ends")
    for _ in range(rounds):
        hit = settle(nearest(left, key, nodes, radius, other_than), "nearest")
        found = hit if found is None else found.union(hit)
        left = settle(left.join(hit.select(*key), key, "left_anti"), "ends")
        radius *= 2
        if not left.limit(1).count():
            return found
        if radius > 100_000:
            break
    every = nodes.select("node_id", F.col("x").alias("rlon"), F.col("y").alias("rlat"))
    every = F.broadcast(every) if every.count() <= BROADCAST_NODES else every
    left = left.where("lon is not null and lat is not null")
    pairs = left.crossJoin(every).withColumn("dist", haversine("lon", "lat", "rlon", "rlat", GREAT_CIRCLE_M))  # what lies far from all nodes
    rest = _closest(_other(pairs, other_than), key)
    return rest if found is None else found.union(rest)


def poi_counts(places: DataFrame, classified: DataFrame, radius: float = 200.0) -> DataFrame:
    """(uid, loc_id, poi): how many features of each class lie around a place.

    A feature counts by the south-west corner of its box (columns min_lon and min_lat), which
    of a point is the point.
    """
    corner = lambda c: F.coalesce(F.col(f"min_{c}"), F.col(c)) if f"min_{c}" in classified.columns else F.col(c)
    near = within_radius(places.select("uid", "loc_id", "lon", "lat"), classified.select(corner("lon").alias("rlon"), corner("lat").alias("rlat"), "activity"), radius)
    counts = near.groupBy("uid", "loc_id").pivot("activity", list(CLASSES)).agg(F.count("activity").cast("double"))
    vector = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in CLASSES])
    return places.select("uid", "loc_id").join(counts.select("uid", "loc_id", vector.alias("poi")), ["uid", "loc_id"], "left").withColumn("poi", F.coalesce("poi", F.array_repeat(F.lit(0.0), len(CLASSES))))


def class_breakdown(classified: DataFrame) -> DataFrame:
    """Count and percentage of each class."""
    counts = classified.groupBy("activity").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def first_of_equals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn = 1").drop("rn")


def data_bounds(places: DataFrame, margin: float = 0.001) -> DataFrame:
    return places.agg((F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"), (F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east"))


# -- pools and population -------------------------------------------------------


def activity_pools(classified: DataFrame, nodes: DataFrame, radius: float = 200.0) -> DataFrame:
    """(activity, node_id): the one nearest node of every classified feature."""
    hit = nearest(classified.where("activity <> 'other'").select("feature_id", "activity", "lon", "lat"), ["feature_id", "activity"], nodes, radius)
    return hit.select("activity", "node_id").distinct()


def landuse_pools(features: DataFrame, nodes: DataFrame, radius: float = 400.0) -> DataFrame:
    """(activity, node_id) of home and work: the one nearest node of every residential or work area."""
    use = F.col("tags")["landuse"]
    label = F.when(use == "residential", "home").when(use.isin("commercial", "industrial", "retail"), "work")
    return activity_pools(features.withColumn("activity", label), nodes, radius)


def augment(pools: DataFrame, nodes: DataFrame, labels: tuple[str, ...] = ("home", "work"), seed: int = 0) -> DataFrame:
    """Pools of ``labels`` get half of all nodes, those of the smallest draws."""
    each = nodes.select("node_id", F.explode(F.array(*map(F.lit, labels))).alias("activity"))
    each = each.withColumn("rn", F.row_number().over(Window.partitionBy("activity").orderBy(uniform(F.lit(seed), "activity", "node_id"), "node_id"))).withColumn("n", F.count("*").over(Window.partitionBy("activity")))
    return pools.union(each.where("rn <= n div 2").select("activity", "node_id")).distinct()


def with_fallback(pools: DataFrame, nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Labels without a node take all nodes."""
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in labels], "activity string")
    empty = wanted.join(pools.select("activity").distinct(), "activity", "left_anti")
    return pools.union(empty.crossJoin(nodes.select("node_id")))  # labels are a handful


def pool_sample(pools: DataFrame, keys: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` nodes without replacement (all, if fewer) for each row of ``keys`` (…, activity)."""
    names = [c for c in keys.columns if c != "activity"]
    ranked = keys.join(pools, "activity").withColumn("rn", F.row_number().over(Window.partitionBy(*keys.columns).orderBy(uniform(F.lit(seed), *names, "activity", "node_id"), "node_id")))
    return ranked.where(F.col("rn") <= n)


def cumulative_population(cells: DataFrame) -> DataFrame:
    """Cells of positive density with their share ``p`` and running share, in raster order."""
    positive = cells.where("density > 0")
    total = positive.agg(F.sum("density").alias("total"))
    share = positive.crossJoin(F.broadcast(total)).withColumn("p", F.col("density") / F.col("total")).drop("total")  # one row
    by_row = share.groupBy("row").agg(F.sum("p").alias("row_p"))
    by_row = by_row.select("row", F.coalesce(F.sum("row_p").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("ahead"))
    within = F.sum("p").over(Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    return share.withColumn("within", within).join(by_row, "row").withColumn("cumulative_p", F.col("ahead") + F.col("within")).drop("ahead", "within")


def nodes_of_cells(cells: DataFrame, nodes: DataFrame, width: float, height: float) -> DataFrame:
    """(row, col, node_id) of nodes in or on the border of a cell; on a border: in both."""
    at = lambda v, size: F.array_distinct(F.array(F.floor(v / size - 1e-9), F.floor(v / size + 1e-9)))
    keyed = nodes.withColumn("i", F.explode(at(F.col("x"), width))).withColumn("j", F.explode(at(F.col("y"), height)))
    span = lambda lo, hi, size: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    spread = cells.withColumn("i", F.explode(span("min_lon", "max_lon", width))).withColumn("j", F.explode(span("min_lat", "max_lat", height)))
    eps = 1e-9
    inside = (F.col("x") >= F.col("min_lon") - eps) & (F.col("x") <= F.col("max_lon") + eps) & (F.col("y") >= F.col("min_lat") - eps) & (F.col("y") <= F.col("max_lat") + eps)
    return keyed.join(spread, ["i", "j"]).where(inside).select("row", "col", "node_id").distinct()


def draw_cells(draws: DataFrame, cumulative: DataFrame, buckets: int = 1024) -> DataFrame:
    """Each draw (…, u) takes the first cell whose running share reaches it; past the end: none.

    Cells and draws meet by the bucket of their share, of which a cell spans those from the
    share before it to its own; so a draw meets the few cells of its bucket.
    """
    order = Window.partitionBy("row").orderBy("col")
    ends = cumulative.groupBy("row").agg(F.max("cumulative_p").alias("last"))
    ends = ends.select("row", F.coalesce(F.lag("last").over(Window.orderBy("row")), F.lit(-1.0)).alias("before_row"))  # a row for each raster row
    spans = cumulative.join(ends, "row").select("row", "col", "cumulative_p", F.coalesce(F.lag("cumulative_p").over(order), F.col("before_row")).alias("above"))
    at = lambda p: F.least(F.greatest(F.floor(p * buckets), F.lit(0)), F.lit(buckets))
    spans = spans.withColumn("bucket", F.explode(F.sequence(at(F.col("above")), at(F.col("cumulative_p")))))
    keyed = draws.withColumn("bucket", at(F.col("u")))
    hit = (keyed.bucket == spans.bucket) & (keyed.u > spans.above) & (keyed.u <= spans.cumulative_p)
    return keyed.join(spans, hit, "left").select(*[keyed[c] for c in draws.columns], "row", "col")


def draw_nodes(keys: DataFrame, cumulative: DataFrame, inside: DataFrame, nodes: DataFrame, n: int, seed: int = 0, digits: int | None = None) -> DataFrame:
    """(…, ord, node_id): ``n`` nodes for each row of ``keys``, a cell by population and a node of it uniformly.

    ``inside``: (row, col, node_id).  A cell without nodes, and a draw past the last cell, give
    any node.  Nodes may repeat, as draws are independent.  ``digits``: draws are rounded, as
    the shares are then.
    """
    names = keys.columns
    u = lambda what: uniform(F.lit(seed), *names, "ord", F.lit(what))
    draws = keys.withColumn("ord", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("u", u("cell") if digits is None else F.round(u("cell"), digits))
    drawn = draw_cells(draws, cumulative).withColumn("v", u("node"))
    own = inside.withColumn("i", F.row_number().over(Window.partitionBy("row", "col").orderBy("node_id")) - 1)
    many = own.groupBy("row", "col").agg(F.count("*").alias("many"))
    every = nodes.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("i"))  # a city's nodes
    total = every.agg(F.count("*").alias("total"))
    placed = drawn.join(many, ["row", "col"], "left").crossJoin(F.broadcast(total))  # one row
    placed = placed.withColumn("i", F.floor(F.col("v") * F.coalesce("many", "total")).cast("int"))
    hit = placed.where("many is not null").join(own, ["row", "col", "i"]).select(*names, "ord", "node_id")
    return hit.union(placed.where("many is null").join(every, "i").select(*names, "ord", "node_id"))
