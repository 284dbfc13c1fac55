"""Readers, writers, the programs end to end, and streams."""

import gzip
import json

from pyspark.sql import functions as F

from wayfold.plans import pipeline
from wayfold.sources import readers, sinks, testbed
from wayfold.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_networks_round_trip(spark, tmp_path):
    text = [
        {"uid": 1, "location_prototype": {"0": [9.1, 45.1], "1": [9.2, 45.2]}, "location_features": {"0": {"loc_support": 5}}, "traj_location_from_to": {"a": ["0", "1"], "b": ["1", "0"]}, "tid_se_times": {"a": [10, 20]}},
        {"uid": 2}, {"uid": 1, "location_prototype": {"0": [9.3, 45.3]}, "location_features": {}, "traj_location_from_to": {"b": [1, 0], "a": ["0", "1"]}, "tid_se_times": {"b": [1, 2], "a": [3, 4]}},
    ]
    with gzip.open(tmp_path / "imns.json.gz", "wt") as f:
        f.write("\n".join([json.dumps(text[0]), "", "{broken", json.dumps(text[1]), json.dumps(text[2])]) + "\n")
    imns = readers.read_imns(spark, str(tmp_path / "imns.json.gz"))
    assert [tuple(r) for r in readers.imn_locations(imns).collect()] == [(1, 0, "0", 9.3, 45.3, 0)]
    assert [tuple(r) for r in readers.imn_trips(imns).orderBy("trip_seq").collect()] == [(1, 0, "1", "0", 1, 2), (1, 1, "0", "1", 3, 4)]
    sinks.write_imns(readers.imn_locations(imns), readers.imn_trips(imns), str(tmp_path / "out"))
    again = readers.read_imns(spark, str(tmp_path / "out"))
    assert again.count() == 1 and readers.imn_trips(again).count() == 2
    (tmp_path / "old.json").write_text(json.dumps({"uid": 7, "03-04": {k: v for k, v in text[0].items() if k != "uid"}}) + "\n" + json.dumps({"uid": 8, "03-04": None}) + "\n")
    assert [r.uid for r in readers.read_old_imns(spark, str(tmp_path / "old.json")).collect()] == [7]


def test_trajectory_files(spark, tmp_path):
    (tmp_path / "user_3_porto_trajectory.csv").write_text("trajectory_id,lat,lon,time,day_date\n0,45.1,9.1,10,2024-01-01\n0,45.2,9.2,20,2024-01-01\n")
    (tmp_path / "user_4_trajectories.json").write_text(json.dumps({"uid": 4, "trajectories": {"1": {"object": [[9.1, 45.1, 5], [9.2, 45.2, 6]], "_start_time": 5}, "2": {"_start_time": 1}}}))
    (tmp_path / "user_3_trajectories.json").write_text(json.dumps({"uid": 3, "trajectories": {"9": {"object": [[1.0, 2.0, 3.0]], "_start_time": 3}}}))
    csv, js = readers.read_trajectory_csv(spark, str(tmp_path)), readers.read_trajectory_json(spark, str(tmp_path))
    assert csv.count() == 2 and js.count() == 3
    merged = readers.merge_trajectories(csv, js)
    assert sorted((r.user_id, r.trajectory_id) for r in merged.collect()) == [(3, 9), (4, 1), (4, 1)]
    assert {r.user_id for r in readers.merge_trajectories(csv, js, 1).collect()} == {3}
    assert readers.matched_originals(js, csv).count() == 1


def test_graph_and_features(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/><graph><node id="1"><data key="d0">9.1</data><data key="d1">45.1</data></node><node id="2"><data key="d0">9.2</data><data key="d1">45.2</data></node><edge source="1" target="2" id="0"><data key="d2">300</data></edge></graph></graphml>')
    nodes, edges = readers.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(tuple(r) for r in nodes.collect()) == [(1, 9.1, 45.1), (2, 9.2, 45.2)]
    assert [(r.u, r.v, r.length, round(r.travel_time, 3)) for r in edges.collect()] == [(1, 2, 300.0, 36.0)]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"id": "node/5", "properties": {"amenity": "cafe", "shop": None}, "geometry": {"type": "Polygon", "coordinates": [[[9.0, 45.0], [9.2, 45.0], [9.2, 45.4]]]}}]}))
    f = readers.read_features(spark, str(tmp_path / "f.geojson")).first()
    assert (f.feature_id, f.tags, round(f.lon, 6), round(f.lat, 6), f.min_lon) == (5, {"amenity": "cafe"}, 9.1, 45.2, 9.0)


def test_cloning_and_evaluation(spark, tmp_path):
    nodes, edges = testbed.road_nodes(spark).cache(), testbed.road_edges(spark).cache()
    city = pipeline.city_of("grid", testbed.features(spark, SF), nodes, edges)
    few = testbed.trips(spark, SF).where("uid = 1 and trip_seq < 20")
    places = testbed.locations(spark, SF).where("uid = 1")
    got = pipeline.clone(places, testbed.poi_vectors(spark, SF).where("uid = 1"), few, city, 0.0)
    points = got.points.cache()
    assert points.count() > 10 and got.skipped.count() == 0
    legs = got.legs.cache()
    assert legs.where("departs < 0 or arrives < departs").count() == 0
    report = pipeline.evaluate(points, testbed.points(spark, SF), with_paths=True)
    stats = report.statistics.cache()
    assert stats.count() == points.select("user_id", "trajectory_id").distinct().count()
    assert report.integrity.first().path_below_od == 0 and report.od_matrix.agg(F.sum("trip_count")).first()[0] == stats.count()
    assert set(report.comparison) == {"duration_seconds", "od_distance_meters", "path_length_meters", "start_hour"}
    assert report.metrics.where("efficiency > 1.000001").count() == 0
    sinks.write_trajectories(points, str(tmp_path / "t"), "grid")
    sinks.write_table(report.od_matrix, str(tmp_path / "od"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == points.count()


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    late = events.agg(F.max("ts")).first()[0]
    last = spark.createDataFrame([(10**9, late.replace(year=late.year + 1), -1, "view", 0.0, "{}")], sessions.EVENTS)
    last.write.mode("append").parquet(str(tmp_path / "e"))  # moves the watermark past the others
    stream = sessions.stream_sessions(sessions.read_events(spark, str(tmp_path / "e"), 10))
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    want = sessions.stream_sessions(events).collect()
    assert sorted(map(str, spark.sql("select * from sessions").collect())) == sorted(map(str, want))
    assert sessions.stream_counts(events, "1 hour", slide="30 minutes").agg(F.sum("n")).first()[0] == 2 * events.count()
