"""The four programs on the command line: networks, pois, clone and evaluate.

``python -m wayfold.cli PROGRAM --help`` lists the options of each.
"""

from __future__ import annotations

import argparse
import contextlib
import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import segment, spatial, stays, timeline
from wayfold.plans import pipeline
from wayfold.sources import cities, readers, sinks

LOG = logging.getLogger("wayfold")


@dataclass(frozen=True)
class CloneOptions:
    """Options of the clone program, with their defaults."""

    imn: str
    poi: str
    features: str
    graph: str
    results_dir: str = "./results"
    prob_subdir: str = "user_probability_reports"
    vis_subdir: str = "user_timeline_visualizations"
    num_users: int | None = None
    spatial_randomness: float = 0.5
    target_city: str = "porto"
    use_random_mapping: bool = False
    seed: int = 42


def parser() -> argparse.ArgumentParser:
    """The command line of all programs."""
    p = argparse.ArgumentParser(prog="wayfold")
    p.add_argument("--log", help="file that also gets the run's messages")
    sub = p.add_subparsers(dest="program", required=True)
    a = sub.add_parser("networks", help="GPS points to networks of places and trips")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--temporal-thr", type=int, default=20, help="minutes of a stop")
    a.add_argument("--spatial-thr", type=int, default=50, help="metres of a stop")
    a.add_argument("--save-trajectories", help="folder for the trips of each person")
    b = sub.add_parser("pois", help="points of interest around the places of networks")
    b.add_argument("input")
    b.add_argument("features", help="map features as GeoJSON")
    b.add_argument("output")
    b.add_argument("--buffer", type=int, default=200, help="metres")
    c = sub.add_parser("clone", help="people's days in another city")
    for name in ("--imn", "--poi", "--features", "--graph"):
        c.add_argument(name, required=True)
    c.add_argument("--results-dir", default=CloneOptions.results_dir)
    c.add_argument("--prob-subdir", default=CloneOptions.prob_subdir)
    c.add_argument("--vis-subdir", default=CloneOptions.vis_subdir)
    c.add_argument("--num-users", type=int)
    c.add_argument("--spatial-randomness", type=float, default=CloneOptions.spatial_randomness)
    c.add_argument("--target-city", default=CloneOptions.target_city, choices=[x[0] for x in cities.CITIES])
    c.add_argument("--use-random-mapping", action="store_true")
    c.add_argument("--seed", type=int, default=CloneOptions.seed)
    d = sub.add_parser("evaluate", help="statistics of trajectories, and comparison with originals")
    d.add_argument("--trajectories", required=True)
    d.add_argument("--output", required=True)
    d.add_argument("--grid-size", type=float, default=500.0)
    d.add_argument("--original")
    d.add_argument("--source-city", default="milan")
    d.add_argument("--target-city", default="porto")
    d.add_argument("--compute-path-metrics", action="store_true")
    d.add_argument("--source-graph", help="road graph of the source city, for path metrics of originals")
    return p


@contextlib.contextmanager
def run_log(path: str | None) -> Iterator[None]:
    """Messages of a run on the terminal, and in a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        LOG.addHandler(h)
    LOG.setLevel(logging.INFO)
    try:
        yield
    finally:
        for h in handlers:
            LOG.removeHandler(h)
            h.close()


def networks(spark: SparkSession, o: argparse.Namespace) -> None:
    segmented = segment.keep_active(segment.segment(readers.read_points(spark, o.input), o.temporal_thr * 60, float(o.spatial_thr)))
    places, trips = segment.build_imn(segmented)
    sinks.write_imns(places, trips, o.output)
    if o.save_trajectories:
        sinks.write_user_trajectories(segmented, o.save_trajectories)
    LOG.info("networks written to %s", o.output)


def pois(spark: SparkSession, o: argparse.Namespace) -> None:
    places = readers.imn_locations(readers.read_imns(spark, o.input))
    counts = spatial.poi_counts(places, spatial.classify(readers.read_features(spark, o.features)), float(o.buffer))
    named = F.array(*map(F.lit, stays.CLASSES))
    lines = counts.groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("loc_id", "poi")))).alias("poi_freq")).select("uid", named.alias("poi_classes"), "poi_freq")
    sinks.write_json_lines(lines, o.output)
    LOG.info("points of interest written to %s", o.output)


def sampled(rows: DataFrame, n: int | None, seed: int) -> DataFrame:
    """The rows of ``n`` people, those of the smallest draws."""
    if n is None:
        return rows
    from wayfold.functions.core import uniform

    people = rows.select("uid").distinct().orderBy(uniform(F.lit(seed), "uid"), "uid").limit(n)
    return rows.join(people, "uid", "left_semi")


def clone(spark: SparkSession, o: argparse.Namespace) -> None:
    config = cities.city_config(o.target_city)
    imns, vectors = readers.read_imns(spark, o.imn), readers.read_pois(spark, o.poi)
    both = sampled(imns.join(vectors.select("uid"), "uid", "left_semi"), o.num_users, o.seed)
    nodes, edges = readers.read_graphml(spark, o.graph)
    nodes = cities.inside(nodes, config, "x", "y")
    city = pipeline.city_of(o.target_city, readers.read_features(spark, o.features), nodes, edges, o.seed)
    places, trips = readers.imn_locations(both), readers.imn_trips(both)
    got = pipeline.clone(places, readers.poi_vectors(vectors), trips, city, o.spatial_randomness, seed=o.seed, keep_pools=not o.use_random_mapping)
    sinks.write_trajectories(got.points, f"{o.results_dir}/synthetic_trajectories", o.target_city)
    days = stays.stays_by_day(stays.stays_of_trips(trips, stays.enrich(places, readers.poi_vectors(vectors))))
    report = sinks.probability_reports(stays.duration_histograms(days), stays.transitions(days), stays.gap_histogram(days))
    sinks.write_json_lines(report, f"{o.results_dir}/{o.prob_subdir}")
    from wayfold.operators import maps

    sinks.write_json_lines(maps.timeline_bars(timeline.day_bundles(days), got.days), f"{o.results_dir}/{o.vis_subdir}")
    LOG.info("%s: people written to %s, without a work place: %d", config.name, o.results_dir, got.skipped.count())


def evaluate(spark: SparkSession, o: argparse.Namespace) -> None:
    points = readers.load_trajectories(spark, o.trajectories, o.target_city)
    originals = readers.load_matched_originals(spark, o.original, points, o.source_city) if o.original else None
    source = None
    if o.source_graph:
        nodes, edges = readers.read_graphml(spark, o.source_graph)
        source = pipeline.City(o.source_city, nodes, edges, nodes.limit(0).selectExpr("'' as activity", "node_id"))
    zone, other = (cities.zone_of(c) or "UTC" for c in (o.target_city, o.source_city))
    report = pipeline.evaluate(points, originals, o.grid_size, zone, other, o.compute_path_metrics, source)
    for name in ("statistics", "od_matrix", "origins", "destinations", "hours", "weekdays"):
        sinks.write_table(getattr(report, name), f"{o.output}/{name}")
    for name in ("coverage", "summary", "integrity"):
        sinks.write_report(getattr(report, name), f"{o.output}/{name}")
    for name, table in report.comparison.items():
        sinks.write_table(table, f"{o.output}/comparison/{name}")
    for name in ("metrics", "original_metrics"):
        if getattr(report, name) is not None:
            sinks.write_table(getattr(report, name), f"{o.output}/{name}")
    LOG.info("evaluation written to %s", o.output)


PROGRAMS = {"networks": networks, "pois": pois, "clone": clone, "evaluate": evaluate}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    with run_log(o.log):
        LOG.info("%s started", o.program)
        PROGRAMS[o.program](spark or SparkSession.builder.appName("wayfold").getOrCreate(), o)


if __name__ == "__main__":
    main()
