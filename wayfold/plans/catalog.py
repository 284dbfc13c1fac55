"""All registered queries of the mobility engine, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import core
from wayfold.operators import compare, grid, mapping, maps, route, segment, spatial, stays, timeline, trajectory
from wayfold.operators.steps import settle
from wayfold.sources import cities, raster, testbed

from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r(c, digits: int = 3) -> F.Column:
    """A rounded double under its own name; minus zero reads as zero."""
    column = F.col(c) if isinstance(c, str) else c
    rounded = F.round(column.cast("double"), digits) + F.lit(0.0)
    return rounded.alias(c) if isinstance(c, str) else rounded


def _stats(spark, d):
    return trajectory.trip_statistics(testbed.points(spark, d))


def _celled(spark, d):
    # The reference point and the cells both read the statistics, a row for each trip: written once.
    return grid.with_cells(settle(_stats(spark, d), "stats"))


def _labels(spark, d):
    return stays.enrich(testbed.locations(spark, d), testbed.poi_vectors(spark, d))


def _stays(spark, d):
    return stays.stays_of_trips(testbed.trips(spark, d), _labels(spark, d))


def _days(spark, d):
    return stays.stays_by_day(_stays(spark, d))


def _classified(spark, d):
    return spatial.classify(testbed.features(spark, d))


KEY = ["user_id", "trajectory_id"]


# -- trips ----------------------------------------------------------------------


@query(f"with {o.STATS} select user_id, trajectory_id, duration_seconds from trips_stat")
def trip_duration(spark, d):
    return _stats(spark, d).select(*KEY, "duration_seconds")


@query(f"with {o.STATS} select user_id, trajectory_id, round(od_distance_meters, 3) as od_distance_meters from trips_stat")
def trip_od_length(spark, d):
    return _stats(spark, d).select(*KEY, r("od_distance_meters"))


@query(f"with {o.STATS} select user_id, trajectory_id, round(path_length_meters, 3) as path_length_meters from trips_stat")
def trip_path_length(spark, d):
    return _stats(spark, d).select(*KEY, r("path_length_meters"))


@query(f"with {o.STATS} select user_id, trajectory_id, round(origin_lat, 6) as origin_lat, round(origin_lon, 6) as origin_lon, round(dest_lat, 6) as dest_lat, round(dest_lon, 6) as dest_lon from trips_stat")
def trip_endpoints(spark, d):
    return _stats(spark, d).select(*KEY, *[r(c, 6) for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon")])


@query(f"with {o.STATS} select user_id, trajectory_id, start_time, start_hour, start_day_of_week from trips_stat")
def temporal_features(spark, d):
    return _stats(spark, d).select(*KEY, "start_time", "start_hour", "start_day_of_week")


@query(f"with {o.STATS} select user_id, trajectory_id, duration_seconds, round(od_distance_meters, 3) as od_distance_meters, round(path_length_meters, 3) as path_length_meters, round(origin_lat, 6) as origin_lat, round(origin_lon, 6) as origin_lon, round(dest_lat, 6) as dest_lat, round(dest_lon, 6) as dest_lon, start_time, start_hour, start_day_of_week from trips_stat")
def trajectory_statistics(spark, d):
    return _stats(spark, d).select(*KEY, "duration_seconds", r("od_distance_meters"), r("path_length_meters"), *[r(c, 6) for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon")], "start_time", "start_hour", "start_day_of_week")


@query(f"with {o.STATS} select count(*) as trips, count(*) filter (path_length_meters < od_distance_meters - 1e-6) as path_below_od from trips_stat")
def integrity_check(spark, d):
    return trajectory.integrity(_stats(spark, d))


# -- grid -----------------------------------------------------------------------


@query(f"with {o.CELLS} select round(ref_lat, 6) as ref_lat, round(ref_lon, 6) as ref_lon from ref")
def reference_origin(spark, d):
    return grid.reference_origin(_stats(spark, d)).select(r("ref_lat", 6), r("ref_lon", 6))


@query(f"with {o.CELLS} select user_id, trajectory_id, origin_cell_x, origin_cell_y, dest_cell_x, dest_cell_y from celled")
def grid_assign(spark, d):
    return _celled(spark, d).select(*KEY, "origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y")


_OD = "select origin_cell_x, origin_cell_y, dest_cell_x, dest_cell_y, count(*) as trip_count, round(first(origin_lat order by user_id, trajectory_id), 6) as origin_lat, round(first(origin_lon order by user_id, trajectory_id), 6) as origin_lon, round(first(dest_lat order by user_id, trajectory_id), 6) as dest_lat, round(first(dest_lon order by user_id, trajectory_id), 6) as dest_lon, round(min(ref_lat), 6) as ref_lat, round(min(ref_lon), 6) as ref_lon from celled group by 1, 2, 3, 4"


def _od_columns():
    return ["origin_cell_x", "origin_cell_y", "dest_cell_x", "dest_cell_y", "trip_count", *[r(c, 6) for c in ("origin_lat", "origin_lon", "dest_lat", "dest_lon", "ref_lat", "ref_lon")]]


@query(f"with {o.CELLS} {_OD}")
def od_matrix(spark, d):
    return grid.od_matrix(_celled(spark, d)).select(*_od_columns())


@query(f"with {o.CELLS} select * from ({_OD}) order by trip_count desc, origin_cell_x, origin_cell_y, dest_cell_x, dest_cell_y limit 20")
def top_od_pairs(spark, d):
    return grid.top_pairs(grid.od_matrix(_celled(spark, d))).select(*_od_columns())


@query(f"with {o.CELLS} select origin_cell_x as cell_x, origin_cell_y as cell_y, count(*) as origin_count from celled group by 1, 2")
def origin_density(spark, d):
    return grid.density(_celled(spark, d), "origin")


@query(f"with {o.CELLS} select dest_cell_x as cell_x, dest_cell_y as cell_y, count(*) as dest_count from celled group by 1, 2")
def destination_density(spark, d):
    return grid.density(_celled(spark, d), "dest")


@query(f"""with {o.CELLS}, box as (select least(min(origin_lat), min(dest_lat)) as a, greatest(max(origin_lat), max(dest_lat)) as b, least(min(origin_lon), min(dest_lon)) as c, greatest(max(origin_lon), max(dest_lon)) as e, (sum(origin_lat) + sum(dest_lat)) / (count(origin_lat) + count(dest_lat)) as mid from trips_stat)
select round(a, 6) as min_lat, round(b, 6) as max_lat, round(c, 6) as min_lon, round(e, 6) as max_lon, round((b - a) * 111e0, 4) as lat_range_km, round((e - c) * 111e0 * cos(radians(mid)), 4) as lon_range_km, round((b - a) * 111e0 * ((e - c) * 111e0 * cos(radians(mid))), 4) as area_km2 from box""")
def spatial_coverage(spark, d):
    return grid.coverage(_stats(spark, d)).select(*[r(c, 6) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], *[r(c, 4) for c in ("lat_range_km", "lon_range_km", "area_km2")])


_SUM = ", ".join(f"round(avg({c}), 3) as {n}_mean, round(quantile_cont({c}, 0.5), 3) as {n}_median, round(stddev_samp({c}), 3) as {n}_std, round(cast(min({c}) as double), 3) as {n}_min, round(cast(max({c}) as double), 3) as {n}_max" for c, n in (("duration_seconds", "duration"), ("od_distance_meters", "od"), ("path_length_meters", "path")))


@query(f"with {o.CELLS} select count(distinct user_id) as users, count(*) as trips, {_SUM}, count(distinct (origin_cell_x, origin_cell_y)) as origin_cells, count(distinct (dest_cell_x, dest_cell_y)) as dest_cells, count(distinct (origin_cell_x, origin_cell_y, dest_cell_x, dest_cell_y)) as od_pairs, round(count(*) / count(distinct user_id), 6) as trips_per_user from celled")
def quality_summary(spark, d):
    s = grid.summary(_celled(spark, d))
    return s.select(*[r(c, 6 if c == "trips_per_user" else 3) if t == "double" else F.col(c) for c, t in s.dtypes])


@query(f"with {o.STATS} select h as hour, coalesce(n, 0) as n from (select cast(i as integer) as h from range(24) r(i)) left join (select start_hour, count(*) as n from trips_stat group by 1) on h = start_hour")
def hour_histogram(spark, d):
    return compare.hour_counts(_stats(spark, d))


@query(f"with {o.STATS} select h as weekday, coalesce(n, 0) as n from (select cast(i as integer) as h from range(7) r(i)) left join (select start_day_of_week, count(*) as n from trips_stat group by 1) on h = start_day_of_week")
def dow_histogram(spark, d):
    return compare.weekday_counts(_stats(spark, d))


@query(f"""with {o.CELLS}, c as (select distinct origin_cell_x as x, origin_cell_y as y, ref_lon, ref_lat from celled)
select x as cell_x, y as cell_y, round(ref_lon + x * 500e0 / (111000e0 * cos(radians(ref_lat))), 6) as west, round(ref_lat + y * 500e0 / 111000e0, 6) as south, round(ref_lon + (x + 1) * 500e0 / (111000e0 * cos(radians(ref_lat))), 6) as east, round(ref_lat + (y + 1) * 500e0 / 111000e0, 6) as north from c""")
def cell_bounds(spark, d):
    c = _celled(spark, d).select(F.col("origin_cell_x").alias("cell_x"), F.col("origin_cell_y").alias("cell_y"), "ref_lon", "ref_lat").distinct()
    west, south = core.cell_corner("cell_x", "cell_y", "ref_lon", "ref_lat", grid.CELL_M)
    east, north = core.cell_corner(F.col("cell_x") + 1, F.col("cell_y") + 1, "ref_lon", "ref_lat", grid.CELL_M)
    return c.select("cell_x", "cell_y", r(west, 6).alias("west"), r(south, 6).alias("south"), r(east, 6).alias("east"), r(north, 6).alias("north"))


@query(f"""with {o.STATS}, v as (select user_id % 2 as half, path_length_meters as v from trips_stat), e as (select min(v) as lo, max(v) as hi from v)
select case half when 0 then 'original' else 'synthetic' end as side, cast(least(49, floor((v - lo) / (hi - lo) * 50)) as integer) as bin, count(*) as n from v, e group by 1, 2""")
def shared_histogram(spark, d):
    s = _stats(spark, d)
    return compare.shared_histogram(s.where("user_id % 2 = 0"), s.where("user_id % 2 = 1"), "path_length_meters")


@query(f"""with {o.STATS}, q as (select start_hour, quantile_cont(path_length_meters, 0.25) as q1, quantile_cont(path_length_meters, 0.5) as median, quantile_cont(path_length_meters, 0.75) as q3 from trips_stat group by 1),
j as (select *, path_length_meters >= q1 - 1.5e0 * (q3 - q1) and path_length_meters <= q3 + 1.5e0 * (q3 - q1) as inside from trips_stat join q using (start_hour))
select start_hour, round(q1, 3) as q1, round(median, 3) as median, round(q3, 3) as q3, round(min(path_length_meters) filter (inside), 3) as low, round(max(path_length_meters) filter (inside), 3) as high, count(*) filter (not inside) as outside from j group by start_hour, q1, median, q3""")
def boxplot_stats(spark, d):
    b = compare.box_stats(_stats(spark, d), ["start_hour"], "path_length_meters")
    return b.select("start_hour", *[r(c) for c in ("q1", "median", "q3", "low", "high")], "outside")


@query(f"""with {o.STATS} select case when duration_seconds > 1500 then -1 else cast(least(9, floor(duration_seconds / 1500e0 * 10)) as integer) end as bin, count(*) as n from trips_stat group by 1""")
def range_histogram(spark, d):
    return compare.fixed_range_histogram(_stats(spark, d), "duration_seconds", 0, 1500, 10)


@query(f"with {o.STATS} select user_id, trajectory_id, round(od_distance_meters, 3) as straight_line_distance, round(path_length_meters, 3) as actual_path_length, round(path_length_meters, 3) as shortest_path_length, case when path_length_meters > 0 then 1e0 end as detour_ratio, round(case when path_length_meters > 0 then od_distance_meters / path_length_meters end, 6) as efficiency from trips_stat where n_points >= 2")
def path_metrics(spark, d):
    m = compare.path_metrics(testbed.points(spark, d), synthetic=True)
    return m.select(*KEY, *[r(c) for c in ("straight_line_distance", "actual_path_length", "shortest_path_length")], r("detour_ratio", 6), r("efficiency", 6))


@query(f"with {o.STATS} select round(avg(e), 6) as efficiency_mean, round(quantile_cont(e, 0.5), 6) as efficiency_median, count(e) as efficiency_n from (select case when path_length_meters > 0 then od_distance_meters / path_length_meters end as e from trips_stat where n_points >= 2)")
def path_metric_summary(spark, d):
    s = compare.metric_summary(compare.path_metrics(testbed.points(spark, d), synthetic=True))
    return s.select(r("efficiency_mean", 6), r("efficiency_median", 6), "efficiency_n")


@query(f"with {o.POINTS}, p as (select user_id, trajectory_id, time % 86400 as rel, cast(date '1970-01-01' + cast(time // 86400 as integer) as varchar) as day, point_seq from points) select user_id, trajectory_id, point_seq, cast(epoch(timezone('Europe/Lisbon', cast(day as timestamp))) as bigint) + rel as unix_time from p")
def relative_to_unix(spark, d):
    p = testbed.points(spark, d).withColumn("rel", F.col("time") % 86400).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("time") / 86400).cast("int")).cast("string"))
    return p.select(*KEY, "point_seq", core.relative_to_unix("day", "rel", "Europe/Lisbon").alias("unix_time"))


# -- habits -----------------------------------------------------------------------


@query(f"with {o.LABELS} select uid, loc_id, activity_label from labels_of")
def enrich_argmax(spark, d):
    return _labels(spark, d).select("uid", "loc_id", "activity_label")


@query("select distinct user_id as uid from events intersect select distinct o_custkey from orders")
def common_users(spark, d):
    e, c = testbed.table(spark, d, "events"), testbed.table(spark, d, "orders")
    return e.select(F.col("user_id").alias("uid")).intersect(c.select(F.col("o_custkey").alias("uid")))


@query(f"select uid from (select distinct user_id as uid from events) order by {o.u01('7', 'uid')}, uid limit 20")
def user_sample(spark, d):
    users = testbed.table(spark, d, "events").select(F.col("user_id").alias("uid")).distinct()
    return users.orderBy(core.uniform(F.lit(7), "uid"), "uid").limit(20)


@query(f"with {o.STAYS} select uid, stay_seq, location_id, activity_label, start_time, end_time, duration from stays", name="stays")
def stays_query(spark, d):
    return _stays(spark, d).select("uid", "stay_seq", "location_id", "activity_label", "start_time", "end_time", "duration")


@query(f"with {o.DAYS} select uid, day_date, stay_seq, location_id, activity_label, start_time, end_time, duration from day_stays", name="stays_by_day")
def stays_by_day_query(spark, d):
    return _days(spark, d).select("uid", "day_date", "stay_seq", "location_id", "activity_label", "start_time", "end_time", "duration")


@query(f"with {o.DAYS} select uid, day_date, stay_seq, activity_label, duration from day_stays where activity_label <> 'home' qualify row_number() over (partition by uid, day_date order by duration desc, stay_seq) = 1")
def anchor_stay(spark, d):
    return stays.anchors(_days(spark, d)).select("uid", "day_date", "stay_seq", "activity_label", "duration")


def _histogram_sql(rows: str, keys: str, value: str, bins: int = 20) -> str:
    return f"""hv as ({rows}), he as (select {keys}, min({value}) as a, max({value}) as b from hv group by {keys}),
hr as (select {keys}, case when a = b then a - 0.5e0 else cast(a as double) end as lo, case when a = b then b + 0.5e0 else cast(b as double) end as hi from he)
select {keys}, cast(least({bins - 1}, floor(({value} - lo) / (hi - lo) * {bins})) as integer) as bin, count(*) as n, round(min(lo), 3) as lo, round(min((hi - lo) / {bins}), 6) as width from hv join hr using ({keys}) group by {keys}, 3"""


@query(f"with {o.DAYS}, {_histogram_sql('select uid, activity_label, duration from day_stays where next_activity is not null', 'uid, activity_label', 'duration')}")
def duration_histogram(spark, d):
    return stays.duration_histograms(_days(spark, d)).select("uid", "activity_label", "bin", "n", r("lo"), r("width", 6))


@query(f"with {o.DAYS} select uid, activity_label as from_activity, next_activity as to_activity, count(*) as n, round(count(*) / sum(count(*)) over (partition by uid, activity_label), 6) as prob from day_stays where next_activity is not null group by 1, 2, 3")
def transition_probs(spark, d):
    return stays.transitions(_days(spark, d)).select("uid", "from_activity", "to_activity", "n", r("prob", 6))


@query(f"with {o.DAYS} select activity_label as from_activity, next_activity as to_activity, count(*) as n, round(count(*) / sum(count(*)) over (partition by activity_label), 6) as prob from day_stays where next_activity is not null group by 1, 2")
def population_transitions(spark, d):
    return stays.transitions(_days(spark, d), by_user=False).select("from_activity", "to_activity", "n", r("prob", 6))


_MATRIX = ("home", "work", "eat", "shop", "unknown")


@query(f"with {o.DAYS}, t as (select activity_label as f, next_activity as to_activity, count(*) / sum(count(*)) over (partition by activity_label) as prob from day_stays where next_activity is not null group by 1, 2) select to_activity, {', '.join(f'''round(coalesce(max(prob) filter (f = '{x}'), 0), 6) as "{x}"''' for x in _MATRIX)} from t group by 1")
def transition_matrix(spark, d):
    m = stays.transition_matrix(stays.transitions(_days(spark, d), by_user=False), list(_MATRIX))
    return m.select("to_activity", *[r(c, 6) for c in _MATRIX])


_EVERY = ("home", "work", "unknown", *stays.CLASSES[1:])


@query(f"with {o.DAYS}, t as (select activity_label as f, next_activity as to_activity, count(*) / sum(count(*)) over (partition by activity_label) as prob from day_stays where next_activity is not null group by 1, 2) select to_activity, {', '.join(f'''round(coalesce(max(prob) filter (f = '{x}'), 0), 6) as "{x}"''' for x in _EVERY)} from t group by 1")
def transition_matrix_all(spark, d):
    m = stays.transition_matrix(stays.transitions(_days(spark, d), by_user=False), list(_EVERY))
    return m.select("to_activity", *[r(c, 6) for c in _EVERY])


@query(f"with {o.TRIPS}, {_histogram_sql('select uid, et - st as ride from trips', 'uid', 'ride').replace(', 3', ', 2')}")
def trip_duration_histogram(spark, d):
    rides = testbed.trips(spark, d).withColumn("ride", F.col("et") - F.col("st"))
    return stays.histogram(rides, ["uid"], "ride").select("uid", "bin", "n", r("lo"), r("width", 6))


@query(f"with {o.DAYS} select count(*) filter (next_start - end_time > 0) as positive_gaps from day_stays")
def stay_gaps(spark, d):
    s = stays.successions(_days(spark, d))
    return s.agg(F.count_if(F.col("next_start") - F.col("end_time") > 0).alias("positive_gaps"))


@query(f"with {o.DAYS} select uid, lower(activity_label) as activity, count(distinct location_id) as required from day_stays group by 1, 2")
def diversity_requirements(spark, d):
    return stays.diversity(_days(spark, d))


@query()
def timeline_levels(spark, d):
    days = _days(spark, d)
    known = timeline.habits(stays.duration_histograms(days), stays.transitions(days))
    pool = stays.transitions(days, by_user=False).select("from_activity", "to_activity", "prob")
    t = timeline.synthetic_days(days, known, pool)
    return t.select("uid", "day_date", "r", F.posexplode("stays").alias("seq", "s")).select("uid", "day_date", "r", "seq", "s.*")


@query(f"""with recursive {o.DAYS},
rel as (select uid, day_date, stay_seq, activity_label as act, start_time - day_start as st, end_time - day_start as et, row_number() over (partition by uid, day_date order by stay_seq) as k, day_date = min(day_date) over (partition by uid) as first_day from day_stays),
anc as (select uid, day_date, stay_seq as anchor_seq from day_stays where activity_label <> 'home' qualify row_number() over (partition by uid, day_date order by duration desc, stay_seq) = 1),
b as (select rel.*, anchor_seq, k = min(k) over (partition by uid, day_date) as is_first, st > 0 and not first_day as lead_in from rel join anc using (uid, day_date)),
pieces as (
  select uid, day_date, stay_seq * 2 + 1 as o, act, case when is_first and stay_seq = anchor_seq and not first_day then 0 else st end as st, case when is_first and stay_seq = anchor_seq and not first_day then greatest(1, et - st) else case when stay_seq = anchor_seq then least(86400, st + greatest(1, et - st)) else et end end as et, stay_seq = anchor_seq as is_anchor, first_day, is_first
  from b where et > st or stay_seq = anchor_seq
  union all select uid, day_date, stay_seq * 2, 'home', 0, st, false, first_day, false from b where is_first and lead_in),
ordered as (select *, row_number() over (partition by uid, day_date order by o) as n, count(*) over (partition by uid, day_date) as cnt, lead(is_anchor) over (partition by uid, day_date order by o) as before_anchor, lead(st) over (partition by uid, day_date order by o) as next_st from pieces)
select uid, day_date, cast(n - 1 as integer) as seq, act, cast(st as integer) as st, cast(case when before_anchor then next_st when n = cnt and not is_anchor then 86400 else et end as integer) as et from ordered""")
def timeline_r0(spark, d):
    t = timeline.synthetic_days(_days(spark, d), levels=(0.0,))
    return t.select("uid", "day_date", F.posexplode("stays").alias("seq", "s")).select("uid", "day_date", "seq", "s.*")


# -- space ------------------------------------------------------------------------


@query(f"with {o.FEATURES} select feature_id, activity from classified")
def classify_features(spark, d):
    return _classified(spark, d).select("feature_id", "activity")


@query(f"with {o.FEATURES} select activity, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 6) as pct from classified group by 1")
def class_breakdown(spark, d):
    return spatial.class_breakdown(_classified(spark, d)).select("activity", "n", r("pct", 6))


@query(f"""with {o.FEATURES}, {o.PLACES},
near as (select p.uid, p.loc_id, c.activity from places p join classified c on abs(p.lat - c.lat) < 0.01 and {o.hav('p.lon', 'p.lat', 'c.lon', 'c.lat', 6371009.0)} <= 200)
select uid, loc_id, {', '.join(f"count(n.activity) filter (n.activity = '{c}') as {c}" for c in stays.CLASSES)} from places left join near n using (uid, loc_id) group by 1, 2""")
def poi_within_radius(spark, d):
    v = spatial.poi_counts(testbed.locations(spark, d), _classified(spark, d))
    return v.select("uid", "loc_id", *[F.col("poi")[i].cast("long").alias(c) for i, c in enumerate(stays.CLASSES)])


@query(f"""with {o.FEATURES}, {o.NODES},
near as (select feature_id, node_id, {o.hav('lon', 'lat', 'x', 'y', 6371009.0)} as dist from classified join nodes on abs(lat - y) < 0.01 and abs(lon - x) < 0.01)
select feature_id, node_id, round(dist, 3) as dist from near where dist <= 200 qualify row_number() over (partition by feature_id order by round(dist, 6), node_id) = 1""")
def nearest_node(spark, d):
    return spatial.nearest(_classified(spark, d), ["feature_id"], testbed.road_nodes(spark), 200.0).select("feature_id", "node_id", r("dist"))


@query(f"""with {o.FEATURES}, {o.NODES} select feature_id, node_id, round(dist, 3) as dist from (select feature_id, node_id, {o.hav('lon', 'lat', 'x', 'y', 6371009.0)} as dist from classified, nodes) qualify row_number() over (partition by feature_id order by round(dist, 6), node_id) = 1""")
def nearest_node_unbounded(spark, d):
    return spatial.nearest_any(_classified(spark, d), ["feature_id"], testbed.road_nodes(spark)).select("feature_id", "node_id", r("dist"))


@query("""with f as (select p_partkey as feature_id, 9.10e0 + (p_partkey * 7907 % 1450) / 10000e0 as lon, 45.40e0 + (p_partkey * 104723 % 990) / 10000e0 as lat, p_partkey % 3 as src_ord from part)
select feature_id from f qualify row_number() over (partition by round(lon * 200), round(lat * 200) order by feature_id) = 1""")
def feature_dedup(spark, d):
    f = testbed.features(spark, d).withColumn("gx", F.round(F.col("lon") * 200)).withColumn("gy", F.round(F.col("lat") * 200))
    return spatial.first_of_equals(f, ["gx", "gy"], "feature_id").select("feature_id")


@query(f"with {o.PLACES} select round(min(lat) - 0.001e0, 6) as south, round(max(lat) + 0.001e0, 6) as north, round(min(lon) - 0.001e0, 6) as west, round(max(lon) + 0.001e0, 6) as east from places")
def data_bounds(spark, d):
    return spatial.data_bounds(testbed.locations(spark, d)).select(*[r(c, 6) for c in ("south", "north", "west", "east")])


@query(f"with {o.POPULATION} select cast(row as integer) as row, cast(col as integer) as col, density, round(p, 9) as p, round(cumulative_p, 9) as cumulative_p from cumulative")
def population_cdf(spark, d):
    return spatial.cumulative_population(testbed.population_cells(spark, d)).select("row", "col", "density", r("p", 9), r("cumulative_p", 9))


@query(f"""with {o.POPULATION}, draws as (select c_custkey as draw_id, {o.u01('3', 'c_custkey')} as u from customer)
select draw_id, cast(arg_min(row, cumulative_p) as integer) as row, cast(arg_min(col, cumulative_p) as integer) as col from draws left join cumulative on round(cumulative_p, 9) >= round(u, 9) group by 1""")
def weighted_node_draw(spark, d):
    draws = testbed.table(spark, d, "customer").select(F.col("c_custkey").alias("draw_id")).withColumn("u", F.round(core.uniform(F.lit(3), "draw_id"), 9))
    c = spatial.cumulative_population(testbed.population_cells(spark, d)).withColumn("cumulative_p", F.round("cumulative_p", 9))
    return spatial.draw_cells(draws, c).select("draw_id", "row", "col")


_IN_CELLS = """held as (
  select row, col, node_id from cells join nodes on x >= 9.10e0 + col * 0.03e0 - 1e-9 and x <= 9.10e0 + col * 0.03e0 + 0.03e0 + 1e-9 and y >= 45.40e0 + (4 - row) * 0.0204e0 - 1e-9 and y <= 45.40e0 + (4 - row) * 0.0204e0 + 0.0204e0 + 1e-9)"""


@query(f"with {o.POPULATION}, {o.NODES}, {_IN_CELLS} select cast(row as integer) as row, cast(col as integer) as col, node_id from held")
def population_cell_nodes(spark, d):
    cells = testbed.population_cells(spark, d).where("density > 0")
    return spatial.nodes_of_cells(cells, testbed.road_nodes(spark), 0.03, 0.0204)


@query(f"""with {o.POPULATION}, {o.NODES}, {_IN_CELLS},
draws as (select c_custkey as k, ord, round({o.u01('5', 'c_custkey', 'ord', "'cell'")}, 9) as u, {o.u01('5', 'c_custkey', 'ord', "'node'")} as v from customer, range(1, 3) r(ord)),
drawn as (select k, ord, any_value(v) as v, arg_min(row, cumulative_p) as row, arg_min(col, cumulative_p) as col from draws left join cumulative on round(cumulative_p, 9) >= u group by 1, 2),
numbered as (select *, row_number() over (partition by row, col order by node_id) - 1 as i, count(*) over (partition by row, col) as many from held)
select k, cast(ord as integer) as ord, node_id from drawn join numbered using (row, col) where i = floor(v * many)
union all
select k, cast(ord as integer), cast(floor(v * 900) as bigint) from drawn where not exists (select 1 from held h where h.row = drawn.row and h.col = drawn.col)""")
def population_nodes(spark, d):
    """Two nodes for each customer: a cell by population, then a node of it."""
    cells, nodes = testbed.population_cells(spark, d), testbed.road_nodes(spark)
    keys = testbed.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    cumulative = spatial.cumulative_population(cells).withColumn("cumulative_p", F.round("cumulative_p", 9))
    inside = spatial.nodes_of_cells(cells.where("density > 0"), nodes, 0.03, 0.0204)
    return spatial.draw_nodes(keys, cumulative, inside, nodes, 2, seed=5, digits=9)


@query(f"with {o.NODES} select node_id from nodes where {o.hav('x', 'y', '9.19e0', '45.4642e0', 6371009.0)} <= 5000")
def city_nodes(spark, d):
    """Road nodes within 5 km of a city's centre."""
    milan = cities.city_config("milan")
    near = cities.CityConfig(milan.name, milan.lat, milan.lon, 5000.0)
    return cities.inside(raster.checked_degrees(testbed.road_nodes(spark), "x", "y"), near, "x", "y").select("node_id")


_POOLS = f"""{o.FEATURES}, {o.NODES},
near as (select feature_id, activity, node_id, {o.hav('lon', 'lat', 'x', 'y', 6371009.0)} as dist from classified join nodes on abs(lat - y) < 0.01 and abs(lon - x) < 0.01 where activity <> 'other'),
pools as (select distinct activity, node_id from (select * from near where dist <= 200 qualify row_number() over (partition by feature_id order by round(dist, 6), node_id) = 1))"""


def _pools(spark, d):
    return spatial.activity_pools(_classified(spark, d), testbed.road_nodes(spark))


@query(f"with {_POOLS} select activity, node_id from pools")
def activity_pools(spark, d):
    return _pools(spark, d)


@query(f"with {_POOLS} select activity, node_id from pools qualify row_number() over (partition by activity order by {o.u01('11', 'activity', 'node_id')}, node_id) <= 10")
def pool_sample(spark, d):
    keys = _pools(spark, d).select("activity").distinct()
    return spatial.pool_sample(_pools(spark, d), keys, 10, seed=11).select("activity", "node_id")


@query(f"""with {o.FEATURES}, {o.NODES},
near as (select feature_id, case landuse when 'residential' then 'home' when 'commercial' then 'work' when 'retail' then 'work' end as activity, node_id, {o.hav('lon', 'lat', 'x', 'y', 6371009.0)} as dist from features join nodes on abs(lat - y) < 0.01 and abs(lon - x) < 0.01)
select distinct activity, node_id from (select * from near where dist <= 400 and activity is not null qualify row_number() over (partition by feature_id order by round(dist, 6), node_id) = 1)""")
def landuse_pools(spark, d):
    return spatial.landuse_pools(testbed.features(spark, d), testbed.road_nodes(spark))


_LABELS12 = ("home", "work", "eat", "health", "utility", "prison")
_AUGMENTED = f"""{_POOLS},
each_ as (select node_id, a as activity, row_number() over (partition by a order by {o.u01('0', 'a', 'node_id')}, node_id) as rn, count(*) over (partition by a) as cnt from nodes, (values ('home'), ('work')) v(a)),
augmented as (select activity, node_id from pools union select activity, node_id from each_ where rn <= cnt // 2)"""


@query(f"with {_AUGMENTED} select activity, node_id from augmented where activity in ('home', 'work')")
def pool_augment(spark, d):
    return spatial.augment(_pools(spark, d), testbed.road_nodes(spark)).where("activity in ('home', 'work')")


@query(f"with {_AUGMENTED}, wanted as (select * from (values {', '.join(f'''('{x}')''' for x in _LABELS12)}) v(activity)) select activity, count(*) as n from (select activity, node_id from augmented union all select activity, node_id from wanted, nodes where activity not in (select activity from augmented)) group by 1")
def pool_fallback(spark, d):
    nodes = testbed.road_nodes(spark)
    return spatial.with_fallback(spatial.augment(_pools(spark, d), nodes), nodes, list(_LABELS12)).groupBy("activity").agg(F.count("*").alias("n"))


# -- mapping and routing ------------------------------------------------------------


_HW = f"""{_AUGMENTED.replace('with ', '')}, {o.PLACES.replace('places as', 'spots as')},
scale as (select h.uid, coalesce(avg({o.hav('h.lon', 'h.lat', 'f.lon', 'f.lat')} / 1000), 0) as scale_km from spots h join spots f on f.uid = h.uid and f.loc_id <> '0' where h.loc_id = '0' group by 1),
hw as (select h.uid, {o.hav('h.lon', 'h.lat', 'w.lon', 'w.lat')} / 1000 as hw_km from spots h join spots w on w.uid = h.uid and w.loc_id = '1' where h.loc_id = '0'),
facts as (select uid, hw_km, scale_km from hw join scale using (uid)),
pool as (select a.activity, n.node_id, x, y, row_number() over (partition by a.activity order by n.node_id) - 1 as idx, count(*) over (partition by a.activity) as n from augmented a join nodes n using (node_id) where a.activity in ('home', 'work')),
wanted as (
  select uid, 'home' as activity, 30 as wanted from facts union all
  select uid, 'work', case when hw_km < 1 then 2000 else 30 end from facts),
tries as (
  select uid, activity, wanted, n, i, {o.u01('0', 'uid', 'activity', 'i')} as u
  from wanted join (select distinct activity, n from pool) using (activity), range(8000) r(i) where i < case when n <= 4 * wanted then n else 2 * wanted end),
throws as (
  select uid, activity, wanted, case when n <= 4 * wanted then i else cast(floor(u * n) as bigint) end as idx, min(case when n <= 4 * wanted then u else i end) as o from tries group by 1, 2, 3, 4),
drawn as (
  select uid, activity, node_id, x, y, nth from (select *, row_number() over (partition by uid, activity order by o, idx) as nth from throws) join pool using (activity, idx) where nth <= wanted),
homes as (select uid, node_id as home, x as hlon, y as hlat from drawn where activity = 'home' and nth <= 20),
works as (select uid, node_id as work, x as wlon, y as wlat from drawn where activity = 'work'),
km as (select uid, home, work, hw_km, scale_km, {o.hav('hlon', 'hlat', 'wlon', 'wlat')} / 1000 as km from homes join works using (uid) join facts using (uid) where home <> work and hw_km > 0),
leveled as (select *, case when km >= hw_km * 0.5e0 and km <= hw_km * 1.5e0 then 0 when km >= hw_km * 0.25e0 and km <= hw_km * 2e0 then 1 else 2 end as level from km),
pairs as (select uid, home, work, level, km, (km / hw_km - 1) * (km / hw_km - 1) * case when km > hw_km then 2 else 1 end + case when scale_km > 0 then ((km - scale_km) / scale_km) * ((km - scale_km) / scale_km) else 0 end as error from leveled qualify level = min(level) over (partition by uid))"""


def _pairs(spark, d):
    places, nodes = testbed.locations(spark, d), testbed.road_nodes(spark)
    pools = spatial.augment(_pools(spark, d), nodes)
    facts = mapping.home_work_distance(places).join(mapping.imn_scale(places), "uid")
    homes, works = mapping.home_work_candidates(facts, pools, nodes)
    return mapping.home_work_pairs(homes, works, facts)


@query(f"with {_HW} select uid, home, work, level, round(km, 6) as km, round(error, 6) as error from pairs")
def home_work_pairs(spark, d):
    return _pairs(spark, d).select("uid", "home", "work", "level", r("km", 6), r("error", 6))


@query(f"with {_HW}, facts2 as (select uid, round(hw_km, 6) as hw_km, round(scale_km, 6) as scale_km from facts) select * from facts2")
def imn_scale(spark, d):
    places = testbed.locations(spark, d)
    return mapping.home_work_distance(places).join(mapping.imn_scale(places), "uid").select("uid", r("hw_km", 6), r("scale_km", 6))


@query(f"""with {_HW}, jit as (select uid, home, work, error * (1 + {o.u01('0', 'uid', 'home', 'work')} * 0.01e0) as error from pairs),
ranked as (select *, row_number() over (partition by uid order by error, home, work) as rn, count(*) over (partition by uid) as n from jit)
select uid, home, work, cast(least(greatest(20, least(n // 5, 100)), n) as bigint) as k from ranked where rn = floor({o.u01('0', "'pair'", 'uid')} * least(greatest(20, least(n // 5, 100)), n)) + 1""")
def pair_topk_choice(spark, d):
    return mapping.choose_pair(_pairs(spark, d)).select("uid", "home", "work", F.col("k").cast("long").alias("k"))


@query()
def map_places(spark, d):
    nodes = testbed.road_nodes(spark)
    return mapping.map_places(_labels(spark, d), spatial.augment(_pools(spark, d), nodes), nodes)


def _od_pairs(spark, d):
    """Pairs of nodes that orders go between: of 60 origins, to any node."""
    orders = testbed.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return orders.select((F.col("o_custkey") % 60 * 15).alias("o"), (F.col("o_orderkey") * 137 % 900).alias("d")).distinct()


@query(f"""with recursive {o.EDGES},
od as (select distinct o_custkey % 60 * 15 as o, o_orderkey * 137 % 900 as d from orders),
dist(o, node, cost) using key (o, node) as (
  select o, o as node, 0e0 as cost from (select distinct o from od)
  union all
  select x.o, x.v, min(x.c) from (select dist.o, e.v, dist.cost + e.travel_time as c from dist join edges e on e.u = dist.node) x
  left join recurring.dist p on p.o = x.o and p.node = x.v where p.cost is null or x.c < p.cost group by 1, 2)
select o, d, case when o = d then 60e0 else cost end as cost from od join dist using (o) where node = d""")
def shortest_path(spark, d):
    return route.shortest_paths(_od_pairs(spark, d), testbed.road_edges(spark)).select("o", "d", "cost")


@query()
def leg_running_time(spark, d):
    edges = testbed.road_edges(spark)
    paths = route.shortest_paths(_od_pairs(spark, d), edges)
    return route.timed_points(paths, testbed.road_nodes(spark), edges).select("o", "d", "i", "node_id", "offset")


@query()
def edge_usage(spark, d):
    return route.edge_usage(route.shortest_paths(_od_pairs(spark, d), testbed.road_edges(spark)))


@query(f"""with recursive {o.DAYS},
legs as (select uid, day_date, row_number() over (partition by uid, day_date order by stay_seq) as seq, start_time - day_start as st_from, end_time - day_start as et_from, next_start - day_start as st_to, 60 + (uid * 7 + stay_seq * 13) % 2400 as dur from day_stays where next_start is not null),
walk as (
  select uid, day_date, seq, case when dur > greatest(0, st_to - et_from) then greatest(st_from, et_from - (dur - greatest(0, st_to - et_from))) else et_from end as departs, st_to, dur, dur > greatest(0, st_to - et_from) as late from legs where seq = 1
  union all
  select l.uid, l.day_date, l.seq, case when l.dur > greatest(0, l.st_to - l.et_from) then greatest(case when w.late then w.departs + w.dur else w.st_to end, l.et_from - (l.dur - greatest(0, l.st_to - l.et_from))) else l.et_from end, l.st_to, l.dur, l.dur > greatest(0, l.st_to - l.et_from)
  from walk w join legs l on l.uid = w.uid and l.day_date = w.day_date and l.seq = w.seq + 1)
select uid, day_date, cast(seq as integer) as seq, departs, departs + dur as arrives from walk""")
def leg_retime(spark, d):
    s = stays.successions(_days(spark, d)).where("next_start is not null").withColumn("seq", F.row_number().over(Window.partitionBy("uid", "day_date").orderBy("stay_seq")))
    rel = lambda c: F.col(c) - F.col("day_start")
    leg = F.struct("seq", rel("start_time").alias("st_from"), rel("end_time").alias("et_from"), rel("next_start").alias("st_to"), (60 + (F.col("uid") * 7 + F.col("stay_seq") * 13) % 2400).alias("dur"))
    legs = s.groupBy("uid", "day_date").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    return timeline.leg_retimes(legs).select("uid", "day_date", F.explode("timed").alias("t")).select("uid", "day_date", "t.*")


# -- tables behind maps and charts ---------------------------------------------------


@query(f"with {o.STATS} select round(origin_lat, 6) as origin_lat, round(origin_lon, 6) as origin_lon, count(*) as n from trips_stat group by trips_stat.origin_lat, trips_stat.origin_lon")
def origin_points(spark, d):
    return maps.origin_points(_stats(spark, d)).select(r("origin_lat", 6), r("origin_lon", 6), "n")


@query(f"""with {o.CELLS}, c as (select origin_cell_x as cell_x, origin_cell_y as cell_y, count(*) as n from celled group by 1, 2), e as (select min(n) as lo, max(n) as hi from c)
select cell_x, cell_y, n, round(case when hi > lo then (n - lo) / cast(hi - lo as double) else 1 end, 6) as share from c, e""")
def origin_density_map(spark, d):
    return maps.density_cells(_celled(spark, d)).select("cell_x", "cell_y", "n", r("share", 6))


@query(f"with {o.CELLS}, top as ({_OD} order by trip_count desc, origin_cell_x, origin_cell_y, dest_cell_x, dest_cell_y limit 20) select round((avg(origin_lat) + avg(dest_lat)) / 2, 4) as lat, round((avg(origin_lon) + avg(dest_lon)) / 2, 4) as lon from top")
def flow_map_centre(spark, d):
    return maps.flow_centre(grid.top_pairs(grid.od_matrix(_celled(spark, d)))).select(r("lat", 4), r("lon", 4))


_COLOUR = "case lower(activity_label) " + " ".join(f"when '{a}' then '{c}'" for a, c in (("home", "darkblue"), ("work", "orange"), ("eat", "green"), ("utility", "purple"), ("transit", "red"), ("unknown", "gray"), ("school", "yellow"), ("shop", "pink"), ("leisure", "lightgreen"), ("health", "lightcoral"), ("admin", "lightblue"), ("finance", "gold"))) + " else 'black' end"
_PLACED = f"{o.DAYS}, placed as (select s.uid, day_date, cast(row_number() over (partition by s.uid, day_date order by stay_seq, start_time) - 1 as integer) as idx, location_id, activity_label, duration, lat, lon from day_stays s join places p on p.uid = s.uid and p.loc_id = s.location_id)"


def _placed(spark, d):
    return maps.stay_places(_days(spark, d), testbed.locations(spark, d))


@query(f"with {_PLACED} select uid, day_date, idx, location_id, activity_label, duration, round(lat, 6) as lat, round(lon, 6) as lon, {_COLOUR} as colour from placed")
def stay_places(spark, d):
    return _placed(spark, d).select("uid", "day_date", "idx", "location_id", "activity_label", "duration", r("lat", 6), r("lon", 6), "colour")


@query(f"with {_PLACED} select uid, day_date, idx, location_id, activity_label from placed qualify activity_label not in ('home', 'work') or row_number() over (partition by uid, location_id order by day_date, idx) = 1")
def day_markers(spark, d):
    return maps.markers(_placed(spark, d), "location_id").select("uid", "day_date", "idx", "location_id", "activity_label")


@query(f"""with {_PLACED}, n as (select *, lead(idx) over w as next_idx, lead(lat) over w as to_lat, lead(lon) over w as to_lon from placed window w as (partition by uid, day_date order by idx))
select uid, day_date, idx as leg, round(lat, 6) as lat, round(lon, 6) as lon, round(to_lat, 6) as to_lat, round(to_lon, 6) as to_lon from n where next_idx = idx + 1""")
def straight_legs(spark, d):
    return maps.straight_legs(_placed(spark, d)).select("uid", "day_date", "leg", *[r(c, 6) for c in ("lat", "lon", "to_lat", "to_lon")])


@query(f"""with {_PLACED}, gps as (select user_id as uid, cast(date '1970-01-01' + cast((min(time) + {o.offset('min(time)')}) // 86400 as integer) as date) as day_date from points group by user_id, trajectory_id),
own as (select uid, day_date, count(*) as lines from gps group by 1, 2),
legs as (select uid, day_date, count(*) as lines from (select *, lead(idx) over (partition by uid, day_date order by idx) as next_idx from placed) where next_idx = idx + 1 group by 1, 2)
select uid, day_date, 'gps' as kind, lines from own union all select uid, day_date, 'straight', lines from legs where not exists (select 1 from own where own.uid = legs.uid and own.day_date = legs.day_date)""".replace("with ", f"with {o.POINTS}, ", 1))
def source_day_lines(spark, d):
    trips = testbed.points(spark, d).groupBy(F.col("user_id").alias("uid"), "trajectory_id").agg(F.min("time").alias("start_time"))
    return maps.source_day_lines(maps.trips_of_days(trips, "Europe/Rome"), _placed(spark, d))


@query(f"""with {o.DAYS}, gapped as (select uid, next_start - end_time + 60 * (stay_seq % 4) as gap from day_stays where next_start is not null),
{_histogram_sql("select uid, gap from gapped where gap > 0", "uid", "gap").replace(', 3', ', 2')}""")
def gap_histogram(spark, d):
    """Gaps between a day's stays, of which every fourth has none, and the others end early."""
    early = _days(spark, d).withColumn("end_time", F.col("end_time") - 60 * (F.col("stay_seq") % 4))
    return stays.gap_histogram(early).select("uid", "bin", "n", r("lo"), r("width", 6))


@query(f"""with {o.TRIPS}, ends as (select uid, trip_seq, to_id as location_id from trips union all select uid, trip_seq, from_id from trips qualify row_number() over (partition by uid order by trip_seq) = 1)
select uid, trip_seq, location_id from ends where location_id = '4'""")
def unknown_places(spark, d):
    return stays.unknown_places(testbed.trips(spark, d), _labels(spark, d).where("loc_id <> '4'"))


# -- ingest -------------------------------------------------------------------------


@query("""with e as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval 20 minutes then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
k as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as session from e)
select user_id, count(*) as n, min(ts) as first, max(ts) as last from k group by user_id, session""")
def sessions(spark, d):
    return segment.sessions(testbed.table(spark, d, "events"), "user_id", "ts")


@query("""select user_id, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2""")
def json_props(spark, d):
    e = testbed.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("user_id", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query(f"""with {o.POINTS}, p as (select user_id as id, lon as longitude, lat as latitude, time as timestamp, row_number() over (partition by user_id order by time, lon, lat) as nth from points),
q as (select b.*, b.timestamp - a.timestamp as dt, case when a.nth is null then true else {o.hav('a.longitude', 'a.latitude', 'b.longitude', 'b.latitude')} > 50 end as moving from p b left join p a on a.id = b.id and a.nth = b.nth - 1),
runs as (select *, sum(cast(moving as integer)) over (partition by id order by nth) as run from q),
rests as (select id, run, max(timestamp) - min(timestamp) >= 1200 as rested from runs group by 1, 2),
cut as (select r.*, dt is null or dt > 1200 or (moving and coalesce(b.rested, false)) as starts from runs r left join rests b on b.id = r.id and b.run = r.run - 1),
trips as (select *, sum(cast(starts as integer)) over (partition by id order by nth) - 1 as tid from cut)
select id, timestamp, round(longitude, 6) as longitude, round(latitude, 6) as latitude, cast(tid as bigint) as tid from trips where id in (select id from trips group by 1 having count(distinct tid) > 2)""")
def segment_points(spark, d):
    p = testbed.points(spark, d).select(F.col("user_id").alias("id"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.col("time").alias("timestamp"))
    return segment.keep_active(segment.segment(p)).select("id", "timestamp", r("longitude", 6), r("latitude", 6), F.col("tid").cast("long").alias("tid"))
