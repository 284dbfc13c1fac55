"""Hand-derived golden cases of the mobility operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import core
from wayfold.operators import compare, mapping, route, segment, spatial, stays, timeline, trajectory
from wayfold.plans import pipeline

LABELS = "uid long, loc_id string, activity_label string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stays_of_two_trips(spark):
    trips = spark.createDataFrame([(1, 0, "0", "1", 1000, 1600), (1, 1, "1", "2", 5000, 5600)], "uid long, trip_seq int, from_id string, to_id string, st long, et long")
    labels = spark.createDataFrame([(1, "0", "home"), (1, "1", "work")], LABELS)
    got = stays.stays_of_trips(trips, labels)
    assert rows(got, "stay_seq", "location_id", "activity_label", "start_time", "end_time") == [(0, "0", "home", 1000, 1600), (1, "1", "work", 1600, 5600), (2, "2", "unknown", 5600, 9200)]


@pytest.mark.parametrize(("start", "border"), [(1174820400, 1174860000), (1174780800, 1174863600)])
def test_days_split_at_the_offset_of_the_start(spark, start, border):
    s = spark.createDataFrame([(1, 0, "0", "home", start, 1174899600)], "uid long, stay_seq int, location_id string, activity_label string, start_time long, end_time long")
    assert rows(stays.stays_by_day(s), "day_date", "start_time", "end_time") == [(dt.date(2007, 3, 25), start, border), (dt.date(2007, 3, 26), border, 1174899600)]


def test_days_of_odd_stays(spark):
    s = spark.createDataFrame([(1, 0, "0", "a", 0, None), (1, 1, "0", "b", None, 5), (1, 2, "0", "c", 86400 - 7200, 86400 - 3600)], "uid long, stay_seq int, location_id string, activity_label string, start_time long, end_time long")
    assert rows(stays.stays_by_day(s), "activity_label", "duration") == [("c", 3600)]  # it ends at midnight in Rome: one day only


def day(spark, items, date=dt.date(2024, 1, 2), uid=1):
    data = [(uid, date, k, str(k), a, b, e, e - b, 0) for k, (a, b, e) in enumerate(items)]
    return spark.createDataFrame(data, "uid long, day_date date, stay_seq int, location_id string, activity_label string, start_time long, end_time long, duration long, day_start long")


def test_transitions_and_durations_leave_the_last_stay_out(spark):
    d = day(spark, [(a, i * 10, i * 10 + 10) for i, a in enumerate(["home", "work", "eat", "work", "home"])])
    got = stays.transitions(d)
    assert rows(got, "from_activity", "to_activity", "prob") == [("eat", "work", 1.0), ("home", "work", 1.0), ("work", "eat", 0.5), ("work", "home", 0.5)]
    assert stays.duration_histograms(d).agg(F.sum("n")).first()[0] == 4


def test_histograms(spark):
    h = lambda values, bins=20: {r.bin: (r.n, r.lo, r.width) for r in stays.histogram(spark.createDataFrame([(v,) for v in values], "v long").withColumn("k", F.lit(1)), ["k"], "v", bins).collect()}
    got = h([600, 1200, 1200, 4000, 30000])
    assert {k: v[0] for k, v in got.items()} == {0: 3, 2: 1, 19: 1} and got[0][1:] == (600.0, 1470.0)
    assert h([5, 5, 5]) == {10: (3, 4.5, 0.05)}
    ranged = compare.fixed_range_histogram(spark.createDataFrame([(1,), (2,), (9,)], "v int"), "v", 0, 5, 5)
    assert rows(ranged, "bin", "n") == [(-1, 1), (1, 1), (2, 1)]


def made(spark, items, first=False, r=0.0):
    d = day(spark, items)
    if not first:
        d = d.union(day(spark, [("work", 0, 100)], dt.date(2024, 1, 1)))
    got = timeline.synthetic_days(d, levels=(r,)).where("day_date = date'2024-01-02'").collect()
    return [tuple(s) for s in got[0].stays] if got else []


def test_timelines_without_randomness(spark):
    assert made(spark, [("home", 0, 28800), ("work", 28800, 61200), ("home", 61200, 82800)]) == [("home", 0, 28800), ("work", 28800, 61200), ("home", 61200, 86400)]
    assert made(spark, [("home", 0, 82800)]) == []
    late = [("home", 3600, 28800), ("work", 28800, 61200)]
    assert made(spark, late)[0] == ("home", 0, 3600)
    assert made(spark, late, first=True)[0] == ("home", 3600, 28800)
    assert made(spark, [("work", 3600, 28800), ("home", 28800, 61200)])[:2] == [("home", 0, 0), ("work", 0, 25200)]


def test_level_0_keeps_the_hours_of_stays(spark):
    # An anchor without length takes a second, and what follows still starts when it did.
    brief = [("home", 0, 1960), ("admin", 1960, 1960), ("home", 1960, 78567), ("home", 78567, 86400)]
    assert made(spark, brief) == [("home", 0, 1960), ("admin", 1960, 1961), ("home", 1960, 78567), ("home", 78567, 86400)]
    # Rome, 31 March 2024: the first stay has the winter offset, the next one the summer offset.
    night, change = 1711839600, 1711845900
    stays_of = lambda data: spark.createDataFrame(data, "uid long, stay_seq int, location_id string, activity_label string, start_time long, end_time long")
    days = stays.stays_by_day(stays_of([(1, 0, "0", "home", night - 90000, night - 80000), (1, 1, "1", "work", night - 80000, change + 20000), (1, 2, "0", "home", change + 20000, change + 30000)]))
    got = timeline.synthetic_days(days, levels=(0.0,)).where("day_date = date'2024-03-31'").first()
    assert [tuple(s) for s in got.stays] == [("work", 0, change + 20000 - night), ("home", change + 20000 - night + 3600, 86400)]


@pytest.mark.parametrize("r", [0.25, 0.5, 1.0])
def test_random_timelines_tile_the_day(spark, r):
    for items in ([("home", 0, 20000), ("work", 20000, 50000), ("eat", 50000, 55000), ("home", 55000, 86400)], [("eat", 0, 9000), ("shop", 9000, 20000), ("work", 20000, 86400)]):
        got = made(spark, items, r=r)
        assert got[0][1] == 0 and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and all(s[1] <= s[2] <= 86400 for s in got)
    with pytest.raises(ValueError):
        timeline.check_level(0.8)


def test_retimed_legs(spark):
    leg = lambda dur, d=1: (d, [(0, 0, 28800, 28800, dur)])
    df = spark.createDataFrame([leg(900.0, 1), leg(40000.0, 2)], "uid long, legs array<struct<seq:int,st_from:int,et_from:int,st_to:int,dur:double>>")
    got = {r.uid: (r.timed[0].departs, r.timed[0].arrives) for r in timeline.leg_retimes(df).collect()}
    assert got == {1: (27900, 28800), 2: (0, 40000)}


def test_enrichment(spark):
    zero, tie = [0.0] * 10, [0.0, 2.0, 2.0] + [0.0] * 7
    places = spark.createDataFrame([(1, str(i), 0.0, 0.0, 1) for i in range(5)], "uid long, loc_id string, lon double, lat double, frequency long")
    vectors = spark.createDataFrame([(1, "0", tie), (1, "1", tie), (1, "2", tie), (1, "3", zero)], "uid long, loc_id string, poi array<double>")
    assert rows(stays.enrich(places, vectors), "loc_id", "activity_label") == [("0", "home"), ("1", "work"), ("2", "admin"), ("3", "unknown"), ("4", "unknown")]


def test_scalars(spark):
    one = spark.range(1).select(
        F.round(core.haversine(F.lit(-8.6107884), F.lit(41.1494512), F.lit(-8.6291), F.lit(41.1579)), 6).alias("m"),
        core.cell_x(F.lit(-8.69), F.lit(-8.7), F.lit(41.0), 500).alias("x"), core.cell_y(F.lit(41.01), F.lit(41.0), 500).alias("y"),
        core.cell_x(F.lit(-8.7001), F.lit(-8.7), F.lit(41.0), 500).alias("nx"), core.cell_y(F.lit(40.9999), F.lit(41.0), 500).alias("ny"),
        core.relative_to_unix(F.lit("2007-04-03"), F.lit(3600), "Europe/Lisbon").alias("unix"),
        core.local_hour(F.lit(1175558400), "Europe/Lisbon").alias("hour"), core.local_weekday(F.lit(1175558400), "Europe/Lisbon").alias("dow"),
        core.relative_to_unix(F.lit("never"), F.lit(5), "Europe/Lisbon").alias("fallback"),
        core.legacy_cell(F.lit(-0.001), F.lit(0.001), 500)[0].alias("lx"), core.ramp_colour(F.lit(0.0)).alias("blue"), core.marker_radius(F.lit(10**6)).alias("big"),
        core.relative_error(F.lit(3.0), F.lit(0.0)).alias("err"), core.relative_rmse(F.lit(6.0), F.lit(3)).alias("rmse"), core.od_label(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("od"),
    ).first()
    assert (one.m, one.x, one.y, one.nx, one.ny) == (1798.067068, 1, 2, -1, -1)
    assert (one.unix, one.hour, one.dow, one.fallback) == (1175558400, 1, 1, 1175558405)
    assert (one.lx, one.blue, one.big, one.err, one.od) == (0, "#0000ff", 10.0, 9.0, "(1,2)→(3,4)") and math.isclose(one.rmse, math.sqrt(2))
    assert 75 < core.degree_scale(9.0, 45.0, 9.2, 45.6) < 80


def test_tag_classes(spark):
    tags = [{"amenity": "events_venue"}, {"amenity": "cafe", "shop": "bakery"}, {"amenity": "bench", "shop": "bakery"}, {"office": "company"}]
    f = spark.createDataFrame([(i, t, 0.0, 0.0) for i, t in enumerate(tags)], "feature_id long, tags map<string,string>, lon double, lat double")
    assert rows(spatial.classify(f), "feature_id", "activity") == [(0, "leisure"), (1, "eat"), (2, "shop"), (3, "other")]
    assert spatial.classify(f, unmatched=None).count() == 3


def test_cumulative_draws(spark):
    cells = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.5), (1, 0, 1.0)], "row int, col int, cumulative_p double")
    draws = spark.createDataFrame([(1, 0.2), (2, 0.21), (3, 1.5)], "draw_id long, u double")
    assert sorted(tuple(r) for r in spatial.draw_cells(draws, cells).select("draw_id", "row", "col").collect()) == [(1, 0, 0), (2, 0, 1), (3, None, None)]


@pytest.mark.parametrize(("n", "k"), [(5, 5), (50, 20), (200, 40), (1000, 100)])
def test_choice_among_the_best(spark, n, k):
    pairs = spark.range(n).select(F.lit(1).alias("uid"), F.col("id").alias("home"), F.col("id").alias("work"), (F.col("id") + 1).cast("double").alias("error"))
    got = mapping.choose_pair(pairs).first()
    assert got.k == k and got.error <= (k + 1) * 1.01


def test_radius_join_equals_the_nested_loop(spark):
    pts = spark.range(300).select("id", (F.col("id") * 7919 % 1000 / 20000.0 + 9.1).alias("lon"), (F.col("id") * 104729 % 1000 / 20000.0 + 45.4).alias("lat"))
    other = pts.select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    for radius in (50.0, 333.0, 2500.0):
        fast = rows(spatial.within_radius(pts, other, radius), "id", "rid")
        slow = rows(pts.crossJoin(other).where(core.haversine("lon", "lat", "rlon", "rlat", core.GREAT_CIRCLE_M) <= radius), "id", "rid")
        assert fast == slow


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2, 0, 10.0, 5.0), (1, 2, 1, 9.0, 4.0), (2, 3, 0, 10.0, 5.0), (1, 3, 0, 30.0, 20.0)], "u long, v long, key int, length double, travel_time double")
    pairs = spark.createDataFrame([(1, 3), (1, 1), (3, 1), (1, 3), (1, 99)], "o long, d long")
    got = {(r.o, r.d): (r.cost, r.nodes) for r in route.shortest_paths(pairs, edges).collect()}
    assert got == {(1, 3): (9.0, [1, 2, 3]), (1, 1): (60.0, [1, 1])}
    assert rows(route.edge_usage(route.shortest_paths(pairs, edges)), "u", "v", "n") == [(1, 2, 1), (2, 3, 1)]


def test_statistics_of_short_and_relative_trips(spark):
    pts = [(1, 1, 45.0, 9.0, 100.0, 0), (2, 5, 45.0, 9.0, 3600.0, 0), (2, 5, 45.01, 9.0, 3700.0, 1)]
    df = spark.createDataFrame([(*p, "2007-04-03") for p in pts], "user_id long, trajectory_id long, lat double, lon double, time double, point_seq long, day_date string")
    got = {r.user_id: r for r in trajectory.trip_statistics(df, "Europe/Lisbon").collect()}
    assert (got[1].od_distance_meters, got[1].path_length_meters, got[1].n_points) == (0.0, 0.0, 1)
    assert (got[2].start_time, got[2].start_hour, got[2].start_day_of_week) == (1175558400, 1, 1)
    bare = {r.user_id: r for r in trajectory.trip_statistics(df.drop("day_date")).collect()}
    assert bare[2].start_hour == 1 and bare[2].start_day_of_week is None
    assert compare.path_metrics(df, synthetic=True).collect()[0].detour_ratio == 1.0


def test_lengths_in_literal_metres(spark):
    pts = [(1, 45.0, 9.0, 0), (2, 45.0, 9.0, 0), (2, 45.01, 9.0, 1), (3, 45.0, 9.0, 0), (3, 45.01, 9.0, 1), (3, 45.01, 9.01, 2), (4, None, 9.0, 0), (4, 45.0, None, 1), (5, None, 9.0, 0), (5, 45.0, 9.0, 1), (5, 45.01, 9.0, 2)]
    df = spark.createDataFrame([(7, t, lat, lon, 100.0 + i, i) for t, lat, lon, i in pts], "user_id long, trajectory_id long, lat double, lon double, time double, point_seq long")
    got = {r.trajectory_id: r for r in trajectory.trip_statistics(df).collect()}
    assert [got[t].path_length_meters for t in (1, 4)] == [0.0, 0.0]
    assert [round(got[t].path_length_meters, 2) for t in (2, 3, 5)] == [1111.95, 1898.08, 1111.95]  # two points, three, a null first
    assert [round(got[t].od_distance_meters, 2) for t in (1, 2, 3, 5)] == [0.0, 1111.95, 1361.81, 1111.95] and got[4].od_distance_meters is None
    assert df.select(core.haversine("lon", "lat", F.lit(9.0), F.lit(45.0)).alias("m")).where("m is null").count() == 3


def test_scale_of_a_person_with_home_alone(spark):
    places = spark.createDataFrame([(1, "0", 9.0, 45.0), (2, "0", 9.0, 45.0), (2, "1", 9.0, 45.01), (2, "2", 9.0, 44.97)], "uid long, loc_id string, lon double, lat double")
    assert [(u, round(s, 4)) for u, s in rows(mapping.imn_scale(places), "uid", "scale_km")] == [(1, 0.0), (2, 2.2239)]


def test_segmentation(spark):
    pts = [(1, 9.0 + i * 0.01, 45.0, i * 60) for i in range(5)] + [(1, 9.04, 45.0, 240 + i * 600) for i in range(1, 4)] + [(1, 9.05 + i * 0.01, 45.0, 2100 + i * 60) for i in range(3)] + [(1, 9.2, 45.0, 9000), (1, 9.3, 45.0, 9060)]
    s = segment.segment(spark.createDataFrame(pts, "id long, longitude double, latitude double, timestamp long"))
    assert sorted(r["count"] for r in s.groupBy("tid").count().collect()) == [2, 3, 8]
    assert segment.keep_active(s).count() == len(pts) and segment.keep_active(s, 3).count() == 0
    places, trips = segment.build_imn(s)
    assert trips.count() == 3 and {r.loc_id for r in places.collect()} == {str(i) for i in range(places.count())}


def test_visits_keep_the_wanted_diversity():
    used: set[int] = set()
    for k in range(6):
        used.add(mapping.choose_visit([1, 2, 3], [5.0, 1.0, 0.0], used, 2, (k,)))
    assert len(used) == 2
    assert mapping.choose_visit([4], [0.0], set(), 1, ("x",)) == 4


def test_places_take_the_candidate_of_least_error():
    """The fold against the definition, with loops over plain numbers."""
    import math

    import pandas as pd

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    import random

    rng = random.Random(5)
    for case in range(12):
        spot = lambda d=0.05: (9 + rng.uniform(-d, d), 45 + rng.uniform(-d, d))
        own = {"0": spot(), "1": spot(), **{str(i): spot(0.004 if case % 2 else 0.05) for i in range(2, 6)}}
        if case % 2:
            own = {k: (own["0"][0] + (v[0] - 9) * 0.1, own["0"][1] + (v[1] - 45) * 0.1) if k > "1" else v for k, v in own.items()}
        width = 0.002 if case % 4 == 1 else 0.05  # all candidates near home, or some
        chosen = {"0": (9.5, 45.5), "1": (9.53, 45.51)}
        scale, pair_error = (0.0 if case == 3 else 2.0), rng.random()
        cand = {k: [(9.5 + rng.uniform(-width, width), 45.5 + rng.uniform(-width, width)) for _ in range(100)] for k in own if k > "1"}
        frequency = {k: rng.randrange(4) for k in own}
        table = [(7, k, int(k), *own[k], frequency[k], int(k) * 1000, *chosen[k], 1, scale, pair_error) for k in chosen]
        table += [(7, k, int(k), *own[k], frequency[k], int(k) * 1000 + n, *c, n + 1, scale, pair_error) for k in cand for n, c in enumerate(cand[k])]
        names = ["uid", "loc_id", "loc_ord", "lon", "lat", "frequency", "node_id", "clon", "clat", "ord", "scale_km", "pair_error"]
        got = mapping.place_rest(pd.DataFrame(table, columns=names))
        mapped, total = dict(chosen), pair_error
        for k in sorted(cand, key=lambda k: (-frequency[k], int(k))):
            away = km(own["0"], own[k])
            options = list(enumerate(cand[k]))
            if away < 1.0:
                near = [x for x in options if km(chosen["0"], x[1]) <= max(5 * away, 2.0)]
                options = near[:30] if near else options
            else:
                options = options[:30]

            def error(c, k=k):
                e = sum(((km(c, mapped[m]) - km(own[k], own[m])) / km(own[k], own[m])) ** 2 for m in mapped)
                if scale > 0:
                    reach = [km(chosen["0"], mapped[m]) for m in mapped if m != "0"] + [km(chosen["0"], c)]
                    e += ((sum(reach) / len(reach) - scale) / scale) ** 2
                return e

            best = min(options, key=lambda x: (error(x[1]), x[0]))
            total += error(best[1])
            assert int(got[got["loc_id"] == k]["node_id"].iloc[0]) == int(k) * 1000 + best[0]
            mapped[k] = best[1]
        assert abs(got["relative_rmse"].iloc[0] - math.sqrt(total / (len(own) * (len(own) - 1) / 2))) < 1e-9


def test_people_who_live_at_work_take_the_nearest_other_node(spark):
    nodes = spark.createDataFrame([(i, 9.0 + i * 0.01, 45.0) for i in range(40)], "node_id long, x double, y double")
    pools = spark.createDataFrame([("home", 3), ("work", 3), ("work", 30), ("work", 39)], "activity string, node_id long")
    facts = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 0.0)], "uid long, hw_km double, scale_km double")
    homes, works = mapping.home_work_candidates(facts, pools, nodes)
    assert mapping.home_work_pairs(homes, works, facts).count() == 0
    got = {r.uid: r for r in mapping.home_work_fallback(homes, pools, nodes, facts).collect()}
    km = 2 * 6371.0 * 3.141592653589793 / 360 * 0.27 * 0.7071067811865476
    assert [(u, r.home, r.work) for u, r in sorted(got.items())] == [(1, 3, 30), (2, 3, 30)]
    assert abs(got[2].error - 2 * 1000 * km) < 5 and abs(got[1].error - got[2].error - ((km - 2) / 2) ** 2) < 0.01
    alone = mapping.home_work_fallback(homes, pools.where("node_id = 3"), nodes, facts).collect()
    assert {(r.home, r.work) for r in alone} == {(3, 3)}


def test_candidates_are_different_nodes_of_the_pool(spark):
    nodes = spark.range(1000).selectExpr("id as node_id", "id / 1000.0 as x", "45.0D as y")
    pools = nodes.selectExpr("'big' as activity", "node_id").union(nodes.where("node_id < 50").selectExpr("'small' as activity", "node_id")).union(nodes.where("node_id < 5").selectExpr("'tiny' as activity", "node_id"))
    keys = spark.createDataFrame([(u, a) for u in range(40) for a in ("big", "small", "tiny", "none")], "uid long, activity string")
    got = mapping.candidates(keys, pools, nodes, 20, 3).collect()
    of = {}
    for r in got:
        of.setdefault((r.uid, r.activity), []).append((r.ord, r.node_id))
    assert set(of) == {(u, a) for u in range(40) for a in ("big", "small", "tiny")}
    for (_, a), drawn in of.items():
        n = 5 if a == "tiny" else 20
        assert sorted(o for o, _ in drawn) == list(range(1, n + 1)) and len({x for _, x in drawn}) == n and max(x for _, x in drawn) < {"big": 1000, "small": 50, "tiny": 5}[a]
    seen = {x for (_, a), drawn in of.items() if a == "big" for _, x in drawn}
    assert len(seen) > 450 and sorted(map(tuple, mapping.candidates(keys, pools, nodes, 20, 3).collect())) == sorted(map(tuple, got))


def test_visits_by_the_rules():
    assert mapping.choose_visit([1, 2], [1.0, 1.0], {1, 2}, 5, ("a",)) in (1, 2)  # nothing new is left
    assert mapping.choose_visit([1, 2, 3], [0.0, 0.0, 9.0], {1}, 1, ("b",)) == 1  # just as many: a used one at once
    assert mapping.choose_visit([1, 2, 3], [0.0, 0.0, 9.0], {1, 2}, 1, ("c",)) in (1, 2)
    assert mapping.choose_visit([1, 2], [9.0, 0.0], {1}, 2, ("d",)) == 2  # the ten draws are refused
    drawn = [mapping.choose_visit([1, 2], [3.0, 1.0], {1, 2}, 2, (k,)) for k in range(400)]
    assert 250 < drawn.count(1) < 350


def test_landuse_areas_fill_home_and_work_pools(spark):
    nodes = spark.createDataFrame([(i, 9.0 + i * 0.01, 45.0) for i in range(12)], "node_id long, x double, y double")
    edges = spark.createDataFrame([], "u long, v long, key int, length double, travel_time double")
    uses = ["residential", "commercial", "industrial", "retail", "forest"]
    f = [(i * 12 + k, {"landuse": use}, 9.0 + k * 0.01, 45.003) for i, use in enumerate(uses) for k in range(i, 12, 5)]
    f += [(100, {"landuse": "residential"}, 9.3, 45.0), (101, {"amenity": "cafe"}, 9.0, 45.0)]  # the first: no node within 400 m
    pools = pipeline.city_of("x", spark.createDataFrame(f, "feature_id long, tags map<string,string>, lon double, lat double"), nodes, edges).pools
    got = {a: {n for x, n in rows(pools, "activity", "node_id") if x == a} for a in ("home", "work", "eat")}
    landuse = spatial.landuse_pools(spark.createDataFrame(f, "feature_id long, tags map<string,string>, lon double, lat double"), nodes)
    assert rows(landuse, "activity", "node_id") == sorted([("home", k) for k in (0, 5, 10)] + [("work", k) for i in (1, 2, 3) for k in range(i, 12, 5)])
    assert {0, 5, 10} <= got["home"] and {1, 2, 3, 6, 7, 8, 11} <= got["work"] and got["eat"] == {0}


@pytest.mark.parametrize("south", [-75.5, 71.0, 88.7])
def test_radius_join_far_from_the_equator(spark, south):
    pts = spark.range(200).select("id", (F.col("id") * 7919 % 1000 / 1000.0 - 0.5).alias("lon"), (F.col("id") * 104729 % 1000 / 2000.0 + south).alias("lat"))
    other = pts.select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    fast = rows(spatial.within_radius(pts, other, 5000.0), "id", "rid")
    assert fast == rows(pts.crossJoin(other).where(core.haversine("lon", "lat", "rlon", "rlat", core.GREAT_CIRCLE_M) <= 5000.0), "id", "rid")


def test_nearest_node_has_no_bound(spark):
    nodes = spark.createDataFrame([(1, 9.0, 45.0), (2, 9.1, 45.0)], "node_id long, x double, y double")
    ends = spark.createDataFrame([("near", 9.0, 45.001), ("far", 12.0, 45.0), ("farther", 100.0, -30.0), ("nowhere", None, 45.0)], "k string, lon double, lat double")
    got = {r.k: (r.node_id, r.dist) for r in spatial.nearest_any(ends, ["k"], nodes, first_radius=64_000.0).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"near": 1, "far": 2, "farther": 2}
    assert 220_000 < got["far"][1] < 235_000
