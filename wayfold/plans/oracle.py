"""SQL building blocks: the derived tables and expressions in DuckDB's dialect."""

from __future__ import annotations

ROME = "Europe/Rome"


def hav(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371000.0) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2)"
    return f"(2e0 * {radius!r}e0 * asin(case when {a} > 1e0 then 1e0 else sqrt({a}) end))".replace("e0e0", "e0")


def offset(ts: str, zone: str = ROME) -> str:
    return f"(cast(epoch(timezone('{zone}', to_timestamp({ts}))) as bigint) - ({ts}))"


def u01(*keys: str) -> str:
    text = " || '|' || ".join(f"cast({k} as varchar)" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296e0)"


POINTS = """points as (
  select o_custkey as user_id, l_orderkey as trajectory_id,
    45.40e0 + (l_partkey * 7919 % 1000) / 10000e0 as lat, 9.10e0 + (l_suppkey * 104729 % 1500) / 10000e0 as lon,
    cast(epoch(o_orderdate) as bigint) + o_orderkey % 86400 + l_linenumber * 300 as time,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as point_seq
  from lineitem join orders on l_orderkey = o_orderkey)"""

STATS = f"""{POINTS},
ranked as (select *, row_number() over (partition by user_id, trajectory_id order by time, point_seq) as nth from points),
hops as (
  select b.user_id, b.trajectory_id, sum({hav("a.lon", "a.lat", "b.lon", "b.lat")}) as metres
  from ranked a join ranked b on a.user_id = b.user_id and a.trajectory_id = b.trajectory_id and b.nth = a.nth + 1 group by 1, 2),
stats as (
  select user_id, trajectory_id, max(time) - min(time) as duration_seconds, coalesce(any_value(metres), 0) as path_length_meters,
    first(lat order by time, point_seq) as origin_lat, first(lon order by time, point_seq) as origin_lon,
    last(lat order by time, point_seq) as dest_lat, last(lon order by time, point_seq) as dest_lon,
    min(time) as start_time, count(*) as n_points
  from points left join hops using (user_id, trajectory_id) group by user_id, trajectory_id),
trips_stat as (
  select *, {hav("origin_lon", "origin_lat", "dest_lon", "dest_lat")} as od_distance_meters,
    cast(floor(((start_time + {offset("start_time")}) % 86400) / 3600) as integer) as start_hour,
    cast(((start_time + {offset("start_time")}) // 86400 + 3) % 7 as integer) as start_day_of_week
  from stats)"""

CELLS = f"""{STATS},
ref as (select least(min(origin_lat), min(dest_lat)) as ref_lat, least(min(origin_lon), min(dest_lon)) as ref_lon from trips_stat),
celled as (
  select *, cast(floor((origin_lon - ref_lon) * 111000e0 * cos(radians(ref_lat)) / 500e0) as bigint) as origin_cell_x, cast(floor((origin_lat - ref_lat) * 111000e0 / 500e0) as bigint) as origin_cell_y,
    cast(floor((dest_lon - ref_lon) * 111000e0 * cos(radians(ref_lat)) / 500e0) as bigint) as dest_cell_x, cast(floor((dest_lat - ref_lat) * 111000e0 / 500e0) as bigint) as dest_cell_y
  from trips_stat, ref)"""

TRIPS = """ev as (
  select user_id as uid, event_id, cast(floor(epoch(ts)) as bigint) as t,
    case event_type when 'view' then '0' when 'click' then '1' when 'purchase' then '2' when 'signup' then '3' else '4' end as loc from events),
seq as (
  select *, lag(loc) over w as from_id, lag(t) over w as before, row_number() over w as n from ev window w as (partition by uid order by t, event_id)),
trips as (select uid, n - 2 as trip_seq, from_id, loc as to_id, t - least(300 + event_id % 1800, t - before) as st, t as et from seq where n > 1)"""

PLACES = """places as (
  select uid, loc_id, 9.10e0 + (k * 7919 % 1400) / 10000e0 as lon, 45.40e0 + (k * 104729 % 900) / 10000e0 as lat, 1 + k % 13 as frequency, k
  from (select uid, loc_id, uid * 31 + cast(loc_id as bigint) * 17 as k from (select distinct user_id as uid from events), (values ('0'), ('1'), ('2'), ('3'), ('4')) v(loc_id)))"""

LABELS = f"""{PLACES},
vectors as (
  select uid, loc_id, list_transform(range(10), lambda i: case when k % 6 = 0 then 0e0 else cast((k + i * 7 + k * i % 11) % 5 as double) end) as poi from places where k % 7 <> 0),
labels_of as (
  select p.uid, p.loc_id, p.lon, p.lat, p.frequency,
    case when loc_id = '1' then 'work' when loc_id = '0' then 'home' else replace(
      ['other','admin','eat','finance','health','leisure','school','shop','transit','utility'][list_position(coalesce(poi, [0e0]), list_max(coalesce(poi, [0e0])))], 'other', 'unknown') end as activity_label
  from places p left join vectors using (uid, loc_id))"""

STAYS = f"""{TRIPS}, {LABELS},
raw_stays as (
  select uid, trip_seq + 1 as stay_seq, to_id as location_id, et as start_time, case when lead(trip_seq) over w is null then et + 3600 else lead(et) over w end as end_time from trips window w as (partition by uid order by trip_seq)
  union all
  select uid, trip_seq, from_id, st, et from (select *, row_number() over (partition by uid order by trip_seq) as rn from trips) where rn = 1),
stays as (
  select r.uid, stay_seq, location_id, coalesce(activity_label, 'unknown') as activity_label, start_time, end_time, end_time - start_time as duration
  from raw_stays r left join labels_of l on r.uid = l.uid and r.location_id = l.loc_id)"""

DAYS = f"""{STAYS},
offs as (select *, {offset("start_time")} as off from stays),
counted as (select *, (start_time + off) // 86400 as day0, cast(ceil((end_time + off) / 86400e0) as bigint) - (start_time + off) // 86400 as n from offs),
days as (
  select uid, date '1970-01-01' + cast(day0 + k as integer) as day_date, stay_seq, location_id, activity_label,
    greatest(start_time, (day0 + k) * 86400 - off) as start_time, least(end_time, (day0 + k + 1) * 86400 - off) as end_time, (day0 + k) * 86400 - off as day_start
  from (select *, unnest(range(n)) as k from counted where n > 0)),
day_stays as (
  select *, end_time - start_time as duration, lead(activity_label) over w as next_activity, lead(start_time) over w as next_start
  from days window w as (partition by uid, day_date order by stay_seq, start_time))"""

FEATURES = """features as (
  select p_partkey as feature_id, 9.10e0 + (p_partkey * 7907 % 1450) / 10000e0 as lon, 45.40e0 + (p_partkey * 104723 % 990) / 10000e0 as lat,
    case when p_partkey % 3 <> 0 then ['cafe','events_venue','bench','bank','school','parking','clinic','fuel'][p_partkey % 8 + 1] end as amenity,
    case when p_partkey % 4 = 0 then ['bakery','mall','books','unknown'][(p_partkey // 4) % 4 + 1] end as shop,
    case when p_partkey % 5 = 0 then ['park','pitch','maze'][(p_partkey // 5) % 3 + 1] end as leisure,
    case when p_partkey % 11 = 0 then ['company','government'][(p_partkey // 11) % 2 + 1] end as office,
    case when p_partkey % 7 = 0 then ['residential','commercial','forest','retail'][(p_partkey // 7) % 4 + 1] end as landuse
  from part),
classified as (
  select *, coalesce(
    case amenity when 'cafe' then 'eat' when 'events_venue' then 'leisure' when 'bank' then 'finance' when 'school' then 'school' when 'parking' then 'transit' when 'clinic' then 'health' when 'fuel' then 'transit' end,
    case office when 'government' then 'admin' end,
    case leisure when 'park' then 'leisure' when 'pitch' then 'leisure' end,
    case shop when 'bakery' then 'shop' when 'mall' then 'shop' when 'books' then 'shop' end, 'other') as activity
  from features)"""

NODES = "nodes as (select i as node_id, 9.10e0 + (i % 30) * 0.005e0 as x, 45.40e0 + (i // 30) * 0.0034e0 as y from range(900) r(i))"

EDGES = f"""{NODES},
one as (select i as u, i + 1 as v from range(900) r(i) where i % 30 < 29 union all select i, i + 30 from range(900) r(i) where i < 870),
edges as (
  select u, v, 300e0 + (u * 37 + v * 11) % 200 as length, floor((300 + (u * 37 + v * 11) % 200) / 10e0) + 1 as travel_time
  from (select u, v from one union all select v, u from one))"""

POPULATION = """cells as (
  select c_nationkey // 5 as row, c_nationkey % 5 as col, cast(count(*) as double) as density from customer group by c_nationkey),
shares as (select *, density / sum(density) over () as p from cells),
cumulative as (select row, col, density, p, sum(p) over (order by row, col rows unbounded preceding) as cumulative_p from shares)"""
