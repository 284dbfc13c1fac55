"""Transplanting people's places to nodes of another city, keeping their distances.

Home and work are chosen by DataFrame operations over sampled candidates; the other places
are a fold per person (each choice depends on those before), as are the visits' nodes.  Both
folds see only a person's own bounded candidates and visits.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.core import haversine, overshoot, relative_error, scale_penalty, uniform

from .spatial import nearest_any

HOME_SAMPLE, HOME_USED, WORK_SAMPLE, WORK_SAMPLE_NEAR, NEAR_KM = 30, 20, 30, 2000, 1.0
PLACE_SAMPLE, PLACE_SCORED = 100, 30
WINDOWS = ((0.5, 1.5), (0.25, 2.0), (0.0, None))


def imn_scale(places: DataFrame, home: str = "0") -> DataFrame:
    """(uid, scale_km): mean distance from home to the other places, 0 without any."""
    h = places.where(F.col("loc_id") == home).select("uid", F.col("lon").alias("hlon"), F.col("lat").alias("hlat"))
    far = places.where(F.col("loc_id") != home).select("uid", "lon", "lat")
    d = h.join(far, "uid", "left").groupBy("uid").agg(F.avg(haversine("hlon", "hlat", "lon", "lat") / 1000).alias("scale_km"))
    return d.withColumn("scale_km", F.coalesce("scale_km", F.lit(0.0)))


def home_work_distance(places: DataFrame, home: str = "0", work: str = "1") -> DataFrame:
    """(uid, hw_km); people without both places have no row (see :func:`unmappable`)."""
    side = lambda p, i: places.where(F.col("loc_id") == i).select("uid", F.col("lon").alias(p + "lon"), F.col("lat").alias(p + "lat"))
    return side("h", home).join(side("w", work), "uid").select("uid", (haversine("hlon", "hlat", "wlon", "wlat") / 1000).alias("hw_km"))


def unmappable(places: DataFrame, work: str = "1") -> DataFrame:
    """People that mapping must skip: those without a work place."""
    return places.select("uid").distinct().join(places.where(F.col("loc_id") == work).select("uid"), "uid", "left_anti")


def candidates(keys: DataFrame, pools: DataFrame, nodes: DataFrame, size, seed: int = 0) -> DataFrame:
    """(…, node_id, lon, lat, ord): for each row of ``keys`` (…, activity) ``size`` different nodes of its pool.

    Nodes of a pool are numbered, and a row draws numbers: from a large pool twice as many as
    wanted, of which the first different ones count; of a pool that is at most four times as
    large as that, all numbers in an order of their draws.  So no row ever meets a whole pool
    of a city, and what it costs is in proportion to ``size``.  A label without a pool gives
    no rows.
    """
    names = keys.columns
    pool = pools.select("activity", "node_id").distinct().join(nodes, "node_id")
    numbered = pool.withColumn("idx", F.row_number().over(Window.partitionBy("activity").orderBy("node_id")).cast("long") - 1)
    many = numbered.groupBy("activity").agg(F.count("*").alias("n"))  # a row for each label
    k = keys.withColumn("wanted", F.lit(size) if isinstance(size, int) else size).join(F.broadcast(many), "activity")
    u = lambda i: uniform(F.lit(seed), *names, i)
    small = F.col("n") <= 4 * F.col("wanted")
    tries = F.sequence(F.lit(0).cast("long"), F.when(small, F.col("n")).otherwise(2 * F.col("wanted")) - 1)
    ordered = F.transform(F.sort_array(F.transform(tries, lambda i: F.struct(u(i).alias("u"), i.alias("i")))), lambda x: x["i"])
    thrown = F.array_distinct(F.transform(tries, lambda i: F.floor(u(i) * F.col("n"))))
    picked = F.slice(F.when(small, ordered).otherwise(thrown), F.lit(1), F.col("wanted").cast("int"))
    rows = k.select(*names, F.posexplode(picked).alias("pos", "idx"))
    return rows.join(numbered, ["activity", "idx"]).select(*names, "node_id", F.col("x").alias("lon"), F.col("y").alias("lat"), (F.col("pos") + 1).alias("ord"))


def home_work_candidates(facts: DataFrame, pools: DataFrame, nodes: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Candidates (uid, node_id, lon, lat, ord) of home and of work for ``facts`` (uid, hw_km, scale_km)."""
    homes = candidates(facts.select("uid", F.lit("home").alias("activity")), pools, nodes, HOME_SAMPLE, seed)
    size = F.when(F.col("hw_km") < NEAR_KM, WORK_SAMPLE_NEAR).otherwise(WORK_SAMPLE)
    near = facts.select("uid", F.lit("work").alias("activity"), size.alias("size"))
    works = [candidates(near.where(F.col("size") == n).select("uid", "activity"), pools, nodes, n, seed) for n in (WORK_SAMPLE, WORK_SAMPLE_NEAR)]
    return homes.drop("activity"), works[0].union(works[1]).drop("activity")


def home_work_pairs(homes: DataFrame, works: DataFrame, facts: DataFrame) -> DataFrame:
    """Scored pairs (uid, home, work, level, error) within the first window that has any.

    ``facts``: (uid, hw_km, scale_km).  An error is the relative squared deviation of the
    distance, doubled beyond it, and the deviation from the person's scale.
    """
    h = homes.where(F.col("ord") <= HOME_USED).select("uid", F.col("node_id").alias("home"), F.col("lon").alias("hlon"), F.col("lat").alias("hlat"))
    w = works.select("uid", F.col("node_id").alias("work"), F.col("lon").alias("wlon"), F.col("lat").alias("wlat"))
    p = h.join(w, "uid").where("home <> work").join(facts.where("hw_km > 0"), "uid").withColumn("km", haversine("hlon", "hlat", "wlon", "wlat") / 1000)
    level = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(WINDOWS))):
        inside = F.col("km") >= F.col("hw_km") * lo
        level = F.when(inside if hi is None else inside & (F.col("km") <= F.col("hw_km") * hi), k).otherwise(level)
    p = p.withColumn("level", level).where("level is not null")
    p = p.withColumn("best", F.min("level").over(Window.partitionBy("uid"))).where("level = best")
    error = overshoot(relative_error("km", "hw_km"), "km", "hw_km") + scale_penalty("km", "scale_km")
    return p.select("uid", "home", "work", "level", "km", error.alias("error"))


def choose_pair(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """One pair for each person, uniformly among the best k after a jitter of up to 1 %.

    k is a fifth of the pairs, at least 20 and at most 100, and never more than there are.
    """
    jittered = pairs.withColumn("error", F.col("error") * (1 + uniform(F.lit(seed), "uid", "home", "work") * 0.01))
    own = Window.partitionBy("uid")
    ranked = jittered.withColumn("rn", F.row_number().over(own.orderBy("error", "home", "work"))).withColumn("n", F.count("*").over(own))
    k = F.least(F.greatest(F.lit(20), F.least(F.floor(F.col("n") / 5), F.lit(100))), F.col("n"))
    return ranked.withColumn("k", k).where(F.col("rn") == F.floor(uniform(F.lit(seed), F.lit("pair"), "uid") * F.col("k")) + 1).drop("rn")


def home_work_fallback(homes: DataFrame, pools: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(uid, home, work, error) where no pair exists: the first home candidate and, of the whole
    pool of work nodes but that one, the node of least error (the candidate itself if there is no other).

    Pairs are missing where home and work are one place, or the pool has one node.  In the first
    case the error, twice the metres and the scale's deviation, grows with the distance, so the
    nearest other work node has the least; it is looked up for each home node, not each person.
    """
    h = homes.where("ord = 1").select("uid", F.col("node_id").alias("home"), F.col("lon").alias("hlon"), F.col("lat").alias("hlat")).join(facts, "uid")
    works = pools.where("activity = 'work'").select("node_id").distinct().join(nodes, "node_id")
    spots = h.select("home", F.col("hlon").alias("lon"), F.col("hlat").alias("lat")).distinct()
    found = nearest_any(spots, ["home"], works, other_than="home").select("home", F.col("node_id").alias("work"))
    xy = nodes.select(F.col("node_id").alias("work"), F.col("x").alias("wlon"), F.col("y").alias("wlat"))
    p = h.join(found, "home", "left").withColumn("work", F.coalesce("work", "home")).join(xy, "work").withColumn("km", haversine("hlon", "hlat", "wlon", "wlat") / 1000)
    off = F.when(F.col("hw_km") > 0, relative_error("km", "hw_km")).otherwise(F.abs(F.col("km") - F.col("hw_km")) * 1000)
    return p.select("uid", "home", "work", (overshoot(off, "km", "hw_km") + scale_penalty("km", "scale_km")).alias("error"))


def _km(lon1, lat1, lon2, lat2):
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def place_rest(rows: pd.DataFrame) -> pd.DataFrame:
    """One person's places in order of frequency, each to the candidate of least error.

    Rows: (uid, loc_id, loc_ord, lon, lat, frequency, node_id, clon, clat, ord, scale_km, pair_error),
    one for each candidate; home and work have the node chosen before as their only candidate, and
    the error of that choice enters the sum.
    """
    uid, scale = rows["uid"].iloc[0], float(rows["scale_km"].iloc[0])
    mapped: list[tuple] = []
    total = 0.0
    order = rows.drop_duplicates("loc_id").assign(rank=lambda x: x["loc_id"].map({"0": 0, "1": 1}).fillna(2)).sort_values(["rank", "frequency", "loc_ord"], ascending=[True, False, True], kind="stable")
    home = None
    for loc, lon, lat in order[["loc_id", "lon", "lat"]].itertuples(index=False):
        c = rows[rows["loc_id"] == loc].sort_values("ord", kind="stable")
        ids, clon, clat = (c[x].to_numpy() for x in ("node_id", "clon", "clat"))
        if home is not None and loc not in ("0", "1"):
            own_km = float(_km(home[1], home[2], lon, lat))
            at = np.arange(len(ids))
            if own_km < NEAR_KM:  # short distances: candidates near home, all of them if none is
                near = _km(home[3], home[4], clon, clat) <= max(5 * own_km, 2.0)
                at = np.flatnonzero(near)[:PLACE_SCORED] if near.any() else at
            else:
                at = at[:PLACE_SCORED]
            ids, clon, clat = ids[at], clon[at], clat[at]
        error = np.zeros(len(ids))
        for _, mlon, mlat, nlon, nlat, _ in mapped:
            own, new = float(_km(mlon, mlat, lon, lat)), _km(nlon, nlat, clon, clat)
            error += ((new - own) / own) ** 2 if own > 0 else (new - own) ** 2
        if home is not None and scale > 0:
            reach = np.array([_km(home[3], home[4], m[3], m[4]) for m in mapped[1:]])
            mean = (reach.sum() + _km(home[3], home[4], clon, clat)) / (len(mapped[1:]) + 1)
            error = error + ((mean - scale) / scale) ** 2
        best = int(np.argmin(error))
        total += float(rows["pair_error"].iloc[0]) if loc == "1" else float(error[best])
        mapped.append((loc, lon, lat, clon[best], clat[best], int(ids[best])))
        if home is None:
            home = mapped[0]
    n = len(mapped)
    rmse = float(np.sqrt(total / (n * (n - 1) / 2))) if n > 1 else 0.0
    return pd.DataFrame([(uid, m[0], m[5], rmse) for m in mapped], columns=["uid", "loc_id", "node_id", "relative_rmse"])


def map_places(places: DataFrame, pools: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(uid, loc_id, node_id, relative_rmse) for places (uid, loc_id, lon, lat, frequency, activity_label).

    People without a work place are left out (:func:`unmappable` lists them).
    """
    facts = home_work_distance(places).join(imn_scale(places), "uid")
    homes, works = home_work_candidates(facts, pools, nodes, seed)
    chosen = choose_pair(home_work_pairs(homes, works, facts), seed).select("uid", "home", "work", "error")
    open_ = facts.join(chosen.select("uid"), "uid", "left_anti")
    pair = chosen.union(home_work_fallback(homes, pools, nodes, open_).select("uid", "home", "work", "error"))
    fixed = pair.select("uid", F.explode(F.create_map(F.lit("0"), "home", F.lit("1"), "work")).alias("loc_id", "node_id")).withColumn("ord", F.lit(1))
    others = places.where("loc_id not in ('0', '1')").join(facts.select("uid"), "uid")
    known = F.broadcast(pools.select("activity").distinct().withColumn("pooled", F.lit(True)))  # a handful of classes
    named = others.join(known, others.activity_label == known.activity, "left").select("uid", "loc_id", F.when(F.col("pooled"), F.col("activity_label")).otherwise("unknown").alias("activity"))
    every = pools.select("activity", "node_id").union(nodes.select(F.lit("unknown").alias("activity"), "node_id"))
    drawn = candidates(named, every, nodes, PLACE_SAMPLE, seed).select("uid", "loc_id", "node_id", "ord")
    xy = nodes.select("node_id", F.col("x").alias("clon"), F.col("y").alias("clat"))
    errors = pair.select("uid", F.col("error").alias("pair_error")).join(facts.select("uid", "scale_km"), "uid")
    both = fixed.unionByName(drawn).join(xy, "node_id").join(places.select("uid", "loc_id", F.col("loc_id").cast("int").alias("loc_ord"), "lon", "lat", "frequency"), ["uid", "loc_id"]).join(errors, "uid")
    return both.groupBy("uid").applyInPandas(place_rest, "uid long, loc_id string, node_id long, relative_rmse double")


def _u(*keys) -> float:
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


def _weighted(options: list[int], weights: list[float], u: float) -> int:
    total = sum(weights)
    seen, got = 0.0, options[-1]
    for n, w in zip(options, weights, strict=True):
        seen += w / total if total > 0 else 1 / len(options)
        if u < seen:
            return n
    return got


def choose_visit(options: list[int], weights: list[float], used: set[int], required: int, key: tuple) -> int:
    """A node for a visit: by frequency, until ``required`` different nodes have been used.

    While more are required only unused nodes are accepted, up to ten draws.  When just as
    many have been used, a new one is refused and a used one drawn by frequency; beyond that,
    uniformly.  If nothing was accepted, a node is drawn uniformly from the unused (if more
    are required) or used ones, or from all.
    """
    left = required - len(used)
    old, new = [n for n in options if n in used], [n for n in options if n not in used]
    uniformly = lambda nodes: nodes[min(len(nodes) - 1, int(_u(*key, "uniform") * len(nodes)))]
    for attempt in range(10):
        got = _weighted(options, weights, _u(*key, attempt))
        if (got not in used) == (left > 0):
            return got
        if left == 0 and old:
            return _weighted(old, [w for n, w in zip(options, weights, strict=True) if n in used], _u(*key, "used"))
        if left < 0 and old:
            return uniformly(old)
    return uniformly(new if left > 0 and new else old or options)


def assign_visits(visits: DataFrame, mapped: DataFrame, places: DataFrame, pools: DataFrame, required: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(uid, day_date, r, stay_seq, node_id) of visits (uid, day_date, r, stay_seq, act).

    Home and work have their nodes; an activity among the person's places takes one of these
    by frequency, with the wanted diversity; else a node of the activity's pool, else any.
    Nodes of pools are numbered and drawn by number; visits and places of a person meet in a
    fold, so nothing of a city's size goes with a visit.
    """
    need = required.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("activity", F.col("required").cast("int")))).alias("required"))
    known = mapped.join(places.select("uid", "loc_id", "frequency", "activity_label"), ["uid", "loc_id"]).join(need, "uid", "left")
    own = known.select("uid", "loc_id", "node_id", F.col("frequency").cast("double").alias("frequency"), F.lower(F.coalesce("activity_label", F.lit(""))).alias("label"), F.to_json("required").alias("required"))
    numbered = pools.select("activity", "node_id").distinct().union(nodes.select(F.lit("*").alias("activity"), "node_id"))
    numbered = numbered.withColumn("idx", F.row_number().over(Window.partitionBy("activity").orderBy("node_id")).cast("long") - 1)
    many = F.broadcast(numbered.groupBy("activity").agg(F.count("*").alias("n")))  # a row for each label
    v = visits.withColumn("activity", F.lower(F.coalesce("act", F.lit("unknown"))))
    v = v.join(many, "activity", "left").crossJoin(many.where("activity = '*'").select(F.col("n").alias("every")))  # one row
    v = v.withColumn("pool", F.when(F.col("n").isNotNull(), F.col("activity")).otherwise("*"))
    v = v.withColumn("idx", F.floor(uniform(F.lit(seed), "uid", "day_date", "r", "stay_seq") * F.coalesce("n", "every")))
    v = v.join(numbered.select(F.col("activity").alias("pool"), "idx", F.col("node_id").alias("spare")), ["pool", "idx"])

    def fold(rows: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        if not len(homes) or not len(rows):
            return pd.DataFrame({"uid": [], "day_date": [], "r": [], "stay_seq": [], "node_id": []})
        homes = homes.sort_values("loc_id", kind="stable")
        by_id = dict(zip(homes["loc_id"], homes["node_id"].astype(int), strict=True))
        wanted = json.loads(homes["required"].iloc[0] or "{}")
        of_label = {label: (g["node_id"].astype(int).tolist(), g["frequency"].tolist()) for label, g in homes.groupby("label")}
        rows = rows.sort_values(["r", "day_date", "stay_seq"], kind="stable")
        used: dict[tuple, set[int]] = {}
        out = []
        for x in rows.itertuples(index=False):
            place = {"home": "0", "work": "1"}.get(x.activity, x.activity)
            node = by_id.get(place)
            if node is None and x.activity in of_label:
                seen = used.setdefault((x.r, x.activity), set())
                node = choose_visit(*of_label[x.activity], seen, wanted.get(x.activity, 0), (seed, x.uid, x.day_date, x.r, x.stay_seq))
                seen.add(node)
            out.append((x.uid, x.day_date, x.r, x.stay_seq, int(x.spare) if node is None else node))
        return pd.DataFrame(out, columns=["uid", "day_date", "r", "stay_seq", "node_id"])

    keep = v.select("uid", "day_date", "r", "stay_seq", "activity", "spare")
    return keep.groupBy("uid").cogroup(own.groupBy("uid")).applyInPandas(fold, "uid long, day_date date, r double, stay_seq int, node_id long")
