"""The engine's programs as single plans over all people."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import compare, grid, mapping, route, spatial, stays, timeline, trajectory
from wayfold.operators.steps import settle


@dataclass(frozen=True)
class City:
    """A target city's tables: (node_id, x, y), (u, v, key, length, travel_time), (activity, node_id)."""

    name: str
    nodes: DataFrame
    edges: DataFrame
    pools: DataFrame


@dataclass(frozen=True)
class Clone:
    """What cloning gives: days, visits' nodes, retimed legs, trajectory points, mapped places."""

    days: DataFrame
    visits: DataFrame
    legs: DataFrame
    points: DataFrame
    places: DataFrame
    skipped: DataFrame


def clone(locations: DataFrame, vectors: DataFrame, trips: DataFrame, city: City, randomness: float, zone: str = "Europe/Rome", seed: int = 0, keep_pools: bool = True) -> Clone:
    """Transplant everyone's days to ``city`` at one level of randomness.

    ``keep_pools=False`` maps places without regard to activities (for comparison); visits
    use the pools all the same.
    """
    timeline.check_level(randomness)
    # Each program's rows are a table of their own: plans stay small, and nothing is computed twice.
    labelled = settle(stays.enrich(locations, vectors), "labelled")
    days = settle(stays.stays_by_day(stays.stays_of_trips(trips, labelled), zone), "days")
    known = settle(timeline.habits(stays.duration_histograms(days), stays.transitions(days)), "habits")
    pooled = settle(stays.transitions(days, by_user=False).select("from_activity", "to_activity", "prob"), "pooled")
    made = settle(timeline.synthetic_days(days, known, pooled, levels=(randomness,), seed=seed), "made")
    pools = city.pools if keep_pools else city.nodes.select(F.explode(F.array(*map(F.lit, ("home", "work")))).alias("activity"), "node_id")
    places = settle(mapping.map_places(labelled, pools, city.nodes, seed), "places")
    visits = made.where(F.size("stays") >= 2).select("uid", "day_date", "r", F.posexplode("stays").alias("stay_seq", "s")).select("uid", "day_date", "r", F.col("stay_seq").cast("int").alias("stay_seq"), "s.act", "s.st", "s.et")
    nodes = settle(mapping.assign_visits(visits, places, labelled, city.pools, stays.diversity(days), city.nodes, seed), "visits")
    placed = visits.join(nodes, ["uid", "day_date", "r", "stay_seq"])
    order = Window.partitionBy("uid", "day_date", "r").orderBy("stay_seq")
    legs = settle(placed.withColumn("to_node", F.lead("node_id").over(order)).withColumn("st_to", F.lead("st").over(order)).where("to_node is not null"), "legs")
    paths = settle(route.shortest_paths(legs.select(F.col("node_id").alias("o"), F.col("to_node").alias("d")), city.edges), "paths")
    routed = settle(legs.join(paths.select(F.col("o").alias("node_id"), F.col("d").alias("to_node"), F.col("cost").alias("dur")), ["node_id", "to_node"]), "routed")
    leg = F.struct(F.col("stay_seq").alias("seq"), F.col("st").alias("st_from"), F.col("et").alias("et_from"), "st_to", "dur")
    timed = timeline.leg_retimes(routed.groupBy("uid", "day_date", "r").agg(F.sort_array(F.collect_list(leg)).alias("legs")))
    times = timed.select("uid", "day_date", "r", F.explode("timed").alias("t")).select("uid", "day_date", "r", F.col("t.seq").alias("stay_seq"), "t.departs", "t.arrives")
    numbered = settle(routed.join(times, ["uid", "day_date", "r", "stay_seq"]).withColumn("trajectory_id", (F.row_number().over(Window.partitionBy("uid").orderBy("day_date", "stay_seq")) - 1).cast("long")), "numbered")
    steps = route.timed_points(paths, city.nodes, city.edges).select(F.col("o").alias("node_id"), F.col("d").alias("to_node"), "i", "lon", "lat", "offset")
    points = numbered.join(steps, ["node_id", "to_node"])
    points = points.select(F.col("uid").alias("user_id"), "trajectory_id", "lat", "lon", (F.col("departs") + F.col("offset")).alias("time"), F.col("day_date").cast("string").alias("day_date"), F.col("i").alias("point_seq"))
    return Clone(made, nodes, numbered, points, places, mapping.unmappable(labelled))


@dataclass(frozen=True)
class Report:
    """Tables of an evaluation."""

    statistics: DataFrame
    od_matrix: DataFrame
    origins: DataFrame
    destinations: DataFrame
    coverage: DataFrame
    summary: DataFrame
    hours: DataFrame
    weekdays: DataFrame
    integrity: DataFrame
    metrics: DataFrame | None
    original_metrics: DataFrame | None
    comparison: dict[str, DataFrame]


PATH_METRICS = ("straight_line_distance", "actual_path_length", "shortest_path_length", "detour_ratio", "efficiency")


def evaluate(points: DataFrame, originals: DataFrame | None = None, cell_m: float = 500.0, zone: str = "Europe/Rome", original_zone: str = "Europe/Rome", with_paths: bool = False, source: City | None = None) -> Report:
    """Statistics of trajectories; with ``originals``, distributions of both over shared bins.

    ``with_paths`` adds path metrics; those of originals need ``source``, the city that they
    were driven in, and are compared over shared bins as well.
    """
    stats = settle(trajectory.trip_statistics(points, zone), "stats")
    celled = settle(grid.with_cells(stats, cell_m), "celled")
    metrics = settle(compare.path_metrics(points, synthetic=True), "metrics") if with_paths else None
    theirs = None
    comparison: dict[str, DataFrame] = {}
    if originals is not None:
        matched = originals.join(points.select("user_id").distinct(), "user_id", "left_semi")
        other = settle(trajectory.trip_statistics(matched, original_zone), "other")
        comparison = {c: compare.shared_histogram(other, stats, c) for c in ("duration_seconds", "od_distance_meters", "path_length_meters", "start_hour")}
        if with_paths and source is not None:
            theirs = settle(compare.path_metrics(matched, source.nodes, source.edges), "theirs")
            comparison |= {c: compare.shared_histogram(theirs, metrics, c) for c in PATH_METRICS}
    return Report(stats, grid.od_matrix(celled), grid.density(celled, "origin"), grid.density(celled, "dest"), grid.coverage(stats), grid.summary(celled), compare.hour_counts(stats), compare.weekday_counts(stats), trajectory.integrity(stats), metrics, theirs, comparison)


def city_of(name: str, features: DataFrame, nodes: DataFrame, edges: DataFrame, seed: int = 0) -> City:
    """A city's pools from map features: nearest nodes; landuse areas' and half of all nodes for home and work."""
    pools = spatial.activity_pools(spatial.classify(features, unmatched=None), nodes).union(spatial.landuse_pools(features, nodes))
    pools = spatial.augment(pools, nodes, seed=seed)
    return City(name, nodes, edges, settle(spatial.with_fallback(pools, nodes, [*stays.CLASSES[1:], "home", "work"]), "pools"))
