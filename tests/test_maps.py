"""Tables behind maps, cities, rasters, loaders and the command line."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold import cli
from wayfold.operators import maps, spatial
from wayfold.operators.steps import settle, shared_folder
from wayfold.sources import cities, raster, readers, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_colours_and_opacity(spark):
    df = spark.createDataFrame([("Home",), ("shop",), ("dancing",), (None,)], "a string")
    got = df.select(maps.colour("a").alias("m"), maps.colour("a", on_timeline=True).alias("t")).collect()
    assert [(r.m, r.t) for r in got] == [("darkblue", "skyblue"), ("pink", "pink"), ("black", "black"), ("gray", "gray")]
    legs = spark.createDataFrame([(0, 1), (0, 3), (1, 3), (2, 3)], "i int, n int").select(F.round(maps.opacity("i", "n"), 3).alias("o")).collect()
    assert [r.o for r in legs] == [1.0, 1.0, 0.725, 0.45]


def test_zones_and_cities(spark):
    assert [cities.zone_of(x) for x in ("Milan", "PORTO", "rome", "paris", None)] == ["Europe/Rome", "Europe/Lisbon", "Europe/Rome", None, None]
    df = spark.createDataFrame([("Lisbon",), ("x",), (None,)], "c string").select(cities.zone_column("c").alias("z"))
    assert [r.z for r in df.collect()] == ["Europe/Lisbon", None, None]
    with pytest.raises(ValueError, match="unknown city"):
        cities.city_config("atlantis")
    assert cities.cities(spark).count() == 3


def test_equal_counts_share_one(spark):
    same = spark.createDataFrame([("a", 4), ("b", 4)], "k string, n int")
    assert rows(maps.normalised(same, "n"), "k", "share") == [("a", 1.0), ("b", 1.0)]
    other = spark.createDataFrame([("a", 2), ("b", 4), ("c", 3)], "k string, n int")
    assert rows(maps.normalised(other, "n"), "k", "share") == [("a", 0.0), ("b", 1.0), ("c", 0.5)]


def test_one_marker_for_home_and_work(spark):
    placed = [(1, "2024-01-01", 0, "0", "home"), (1, "2024-01-01", 1, "2", "eat"), (1, "2024-01-01", 2, "0", "home"), (1, "2024-01-02", 0, "0", "home"), (1, "2024-01-02", 1, "2", "eat"), (2, "2024-01-02", 0, "0", "home")]
    df = spark.createDataFrame(placed, "uid long, day_date string, idx int, location_id string, activity_label string")
    got = rows(maps.markers(df, "location_id"), "uid", "day_date", "idx", "on_all_days")
    assert got == [(1, "2024-01-01", 0, True), (1, "2024-01-01", 1, False), (1, "2024-01-02", 1, False), (2, "2024-01-02", 0, True)]


def test_days_of_gps_trips_and_their_lines(spark):
    trips = spark.createDataFrame([(1, 5, 1175552000), (1, 6, 1175558000), (1, 7, 0), (1, 8, None)], "uid long, trajectory_id long, start_time long")
    got = rows(maps.trips_of_days(trips, "Europe/Rome"), "trajectory_id", "day_date")
    assert [(i, str(d)) for i, d in got] == [(5, "2007-04-03"), (6, "2007-04-03")]
    assert [str(d) for _, d in rows(maps.trips_of_days(trips, "UTC"), "trajectory_id", "day_date")] == ["2007-04-02", "2007-04-02"]
    points = spark.createDataFrame([(1, "d1", 0, 0, 1.0, 1.0), (1, "d1", 0, 1, 2.0, 2.0), (1, "d1", 1, 0, 3.0, 3.0), (1, "d2", 0, 0, 9.0, 9.0)], "user_id long, day_date string, trajectory_id long, point_seq long, lat double, lon double")
    assert rows(maps.target_centre(points), "user_id", "lat", "lon") == [(1, 2.0, 2.0)]
    assert "a.html" in maps.split_view("a.html", "b.html", "t") and "b.html" in maps.split_view("a.html", "b.html", "t")


def test_bars_of_original_and_synthetic_days(spark):
    days = spark.createDataFrame([(1, "d", [(0, "home", 0, 50), (1, "work", 50, 90)], 1)], "uid long, day_date string, stays array<struct<stay_seq:int,act:string,st:int,et:int>>, anchor_seq int")
    made = spark.createDataFrame([(1, "d", 0.5, [("home", 0, 60)]), (1, "d", 0.0, [("eat", 0, 70)])], "uid long, day_date string, r double, stays array<struct<act:string,st:int,et:int>>")
    assert rows(maps.timeline_bars(days, made), "lane", "act", "outlined", "colour") == [(0, "home", False, "skyblue"), (0, "work", True, "orange"), (1, "eat", False, "green"), (2, "home", False, "skyblue")]
    legs = spark.createDataFrame([(1, "d", 0.0, 3), (1, "d", 0.0, 7)], "uid long, day_date string, r double, stay_seq int")
    assert rows(maps.leg_lines(legs), "stay_seq", "i", "opacity") == [(3, 0, 1.0), (7, 1, 0.45)]


def tiff(cells: np.ndarray, west: float, north: float, step: float, rows_in_strip: int, deflate: bool, predictor: int = 1, system: int = 4326) -> bytes:
    """A small GeoTIFF in strips."""
    h, w = cells.shape
    strips = []
    for at in range(0, h, rows_in_strip):
        own = cells[at : at + rows_in_strip]
        if predictor == 3:
            own = own.astype(">f4").view(np.uint8).reshape(len(own), w, 4).transpose(0, 2, 1).reshape(len(own), -1).astype(np.int16)
            raw = np.diff(own, axis=1, prepend=0).astype(np.uint8).tobytes()
        else:
            raw = own.astype("<f4").tobytes()
        strips.append(zlib.compress(raw) if deflate else raw)
    body, at = b"", []
    for s in strips:
        at.append(8 + len(body))
        body += s
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (273, 4, at), (277, 3, [1]), (278, 3, [rows_in_strip]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (339, 3, [3]),
               (33550, 12, [step, step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (34735, 3, [1, 1, 0, 1, 2048, 0, 1, system]), (42113, 2, b"-9999\0")]
    start = 8 + len(body)
    spare = start + 2 + 12 * len(entries) + 4
    table, extra = struct.pack("<H", len(entries)), b""
    for tag, kind, values in entries:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
        table += struct.pack("<HHI", tag, kind, len(values))
        if len(raw) <= 4:
            table += raw.ljust(4, b"\0")
        else:
            table += struct.pack("<I", spare + len(extra))
            extra += raw
    return b"II" + struct.pack("<HI", 42, start) + body + table + struct.pack("<I", 0) + extra


@pytest.mark.parametrize(("deflate", "predictor"), [(False, 1), (True, 1), (True, 3)])
def test_rasters_are_read_by_their_strips(spark, tmp_path, deflate, predictor):
    cells = np.random.default_rng(1).integers(-1, 5, (20, 30)).astype(np.float32)
    cells[3, 4] = -9999
    (tmp_path / "p.tif").write_bytes(tiff(cells, 9.0, 46.0, 0.1, 3, deflate, predictor))
    got = {(r.row, r.col): r for r in raster.read_population_raster(spark, str(tmp_path / "p.tif"), 9.55, 44.95, 10.45, 45.45).collect()}
    want = {(r - 5, c - 5): cells[r, c] for r in range(5, 11) for c in range(5, 15) if cells[r, c] > 0}
    assert {k: r.density for k, r in got.items()} == want
    some = next(iter(want))
    assert abs(got[some].min_lon - (9.0 + (some[1] + 5) * 0.1)) < 1e-9 and abs(got[some].max_lat - (46.0 - (some[0] + 5) * 0.1)) < 1e-9 and abs(got[some].max_lat - got[some].min_lat - 0.1) < 1e-9
    assert raster.read_population_raster(spark, str(tmp_path / "p.tif"), 50.0, 10.0, 51.0, 11.0).count() == 0


def test_other_coordinates_are_refused(spark, tmp_path):
    (tmp_path / "p.tif").write_bytes(tiff(np.ones((2, 2), np.float32), 0.0, 0.0, 1.0, 1, False, system=3003))
    with pytest.raises(ValueError, match="WGS 84"):
        raster.read_population_raster(spark, str(tmp_path / "p.tif"), 0, 0, 1, 1)
    df = spark.createDataFrame([(500_000.0, 45.0)], "x double, y double")
    with pytest.raises(Exception, match="degrees"):
        raster.checked_degrees(df, "x", "y").collect()
    assert raster.graph_bounds(spark.createDataFrame([(9.0, 45.0), (9.5, 44.0)], "x double, y double")).first().asDict() == {"west": 9.0, "south": 44.0, "east": 9.5, "north": 45.0}


def test_draws_take_the_first_cell_that_reaches_them(spark):
    cells = spark.createDataFrame([(r, c, float((r * 7 + c * 3) % 4)) for r in range(6) for c in range(6)], "row int, col int, density double")
    cumulative = spatial.cumulative_population(cells)
    order = sorted((r.cumulative_p, r.row, r.col) for r in cumulative.collect())
    draws = spark.createDataFrame([(i, i / 97) for i in range(98)], "k long, u double")
    for buckets in (1, 5, 1024):
        got = {r.k: (r.row, r.col) for r in spatial.draw_cells(draws, cumulative, buckets).collect()}
        assert got == {i: next(((r, c) for p, r, c in order if p >= i / 97), (None, None)) for i in range(98)}


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "user_1_porto_trajectory.csv").write_text("trajectory_id,lat,lon,time,day_date\n0,45.1,9.1,10,2024-01-01\n")
    (tmp_path / "user_2_porto_trajectory.csv").write_text('lon,"lat",time,trajectory_id\r\n9.5,45.5,20,3\r\n\r\n9.6,bad,21,3\r\n')
    (tmp_path / "user_3_porto_trajectory.csv").write_text("trajectory_id,lat,lon\n0,45.1,9.1\n")
    (tmp_path / "user_x_porto_trajectory.csv").write_text("trajectory_id,lat,lon,time\n0,45.1,9.1,1\n")
    (tmp_path / "user_9_trajectory.csv").write_text("trajectory_id,lat,lon,time\n0,1.0,2.0,3\n")
    (tmp_path / "user_2_trajectories.json").write_text(json.dumps({"trajectories": {"7": {"object": [[9.9, 45.9, 5]], "_start_time": 5}}}))
    (tmp_path / "user_5_trajectories.json").write_text(json.dumps({"trajectories": {"1": {"object": [[9.0, 45.0, 5]], "_start_time": 86405}}}))
    csv = readers.read_trajectory_csv(spark, str(tmp_path), "user_*_porto_trajectory.csv")
    assert [(r.user_id, r.trajectory_id, r.lat, r.lon, r.day_date) for r in csv.orderBy("user_id", "point_seq").collect()] == [(1, 0, 45.1, 9.1, "2024-01-01"), (2, 3, 45.5, 9.5, None), (2, 3, None, 9.6, None)]
    both = readers.load_trajectories(spark, str(tmp_path))
    assert rows(both, "user_id", "trajectory_id") == [(1, 0), (2, 7), (5, 1)] and {r.user_id: r.day_date for r in both.collect()}[1] == "2024-01-01"
    assert rows(readers.load_trajectories(spark, str(tmp_path), limit_users=1), "user_id", "trajectory_id") == [(1, 0), (2, 7)]
    wanted = spark.createDataFrame([(1,), (2,), (9,), (77,)], "user_id long")
    assert rows(readers.load_matched_originals(spark, str(tmp_path), wanted), "user_id", "trajectory_id") == [(1, 0), (2, 7), (9, 0)]
    assert rows(readers.read_gps_trips(spark, str(tmp_path), 5), "user_id", "trajectory_id", "start_time") == [(5, 1, 86405)]


def test_reports_have_trip_durations(spark):
    h = spark.createDataFrame([(1, "home", 0, 5, 0.0, 10.0), (1, "home", 19, 1, 0.0, 10.0)], "uid long, activity_label string, bin int, n long, lo double, width double")
    t = spark.createDataFrame([(1, "home", "eat", 1.0), (2, "home", "eat", 1.0)], "uid long, from_activity string, to_activity string, prob double")
    got = {r.uid: r for r in sinks.probability_reports(h, t, h.drop("activity_label")).collect()}
    assert got[1].trip_duration_probs.hist == [5] + [0] * 18 + [1] and got[1].trip_duration_probs.bins[-1] == 200.0 and got[2].trip_duration_probs is None
    assert sinks.probability_reports(h, t).where("trip_duration_probs is not null").count() == 0


def test_bucketed_writing(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, 1.0, 2.0) for i in range(50)], "user_id long, trajectory_id long, lat double, lon double")
    sinks.write_trajectories(df, str(tmp_path / "t"), "x", buckets=4)
    assert len(list((tmp_path / "t" / "city=x").glob("bucket=*"))) <= 4 and spark.read.option("header", True).csv(str(tmp_path / "t")).select("user_id").distinct().count() == 50


def test_settled_steps_are_tables(spark):
    df = settle(spark.range(5).withColumnRenamed("id", "k"))
    assert df.columns == ["k"] and df.count() == 5 and df.inputFiles() and shared_folder(spark)


def test_command_line(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,longitude,latitude,timestamp\n" + "\n".join(f"1,{9.0 + (i // 4) * 0.02 + (i % 4) * 0.004},{45.0},{i % 4 * 300 + i // 4 * 9000}" for i in range(20)) + "\n")
    cli.main(["--log", str(tmp_path / "log" / "run.log"), "networks", str(tmp_path / "p.csv"), str(tmp_path / "imn")], spark)
    imns = readers.read_imns(spark, str(tmp_path / "imn"))
    assert imns.count() == 1 and readers.imn_trips(imns).count() == 5
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [{"id": "n/1", "properties": {"amenity": "cafe"}, "geometry": {"type": "Point", "coordinates": [9.0, 45.0]}}]}))
    cli.main(["pois", str(tmp_path / "imn"), str(tmp_path / "f.geojson"), str(tmp_path / "poi")], spark)
    assert readers.poi_vectors(readers.read_pois(spark, str(tmp_path / "poi"))).where("poi[2] = 1").count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "user_1_porto_trajectory.csv").write_text("trajectory_id,lat,lon,time\n0,41.1,-8.6,1175558400\n0,41.2,-8.6,1175558500\n")
    cli.main(["evaluate", "--trajectories", str(tmp_path / "t"), "--output", str(tmp_path / "out"), "--compute-path-metrics"], spark)
    stats = spark.read.option("header", True).csv(str(tmp_path / "out" / "statistics")).collect()
    assert len(stats) == 1 and abs(float(stats[0].path_length_meters) - 11119.49) < 0.1 and spark.read.option("header", True).csv(str(tmp_path / "out" / "metrics")).count() == 1
    assert "networks started" in (tmp_path / "log" / "run.log").read_text()
    o = cli.parser().parse_args(["clone", "--imn", "a", "--poi", "b", "--features", "c", "--graph", "d"])
    assert (o.spatial_randomness, o.target_city, o.seed, o.num_users, o.use_random_mapping) == (0.5, "porto", 42, None, False)
