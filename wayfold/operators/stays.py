"""From trips to stays, days, habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.core import DAY_S, utc_offset

# Activity classes in the order of their ids (fixed values).
CLASSES = ("other", "admin", "eat", "finance", "health", "leisure", "school", "shop", "transit", "utility")
LAST_STAY_S = 3600


def enrich(locations: DataFrame, vectors: DataFrame, home: str = "0", work: str = "1") -> DataFrame:
    """Locations with ``activity_label``: the class most often near, the first of equals.

    No vector or only zeros give ``other``, which reads ``unknown``; home and work are by id.
    """
    j = locations.join(vectors, ["uid", "loc_id"], "left")
    poi = F.coalesce("poi", F.array_repeat(F.lit(0.0), len(CLASSES)))
    best = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(poi, F.array_max(poi)).cast("int"))
    label = F.when(F.col("loc_id") == work, "work").when(F.col("loc_id") == home, "home").when(best == "other", "unknown").otherwise(best)
    return j.withColumn("activity_label", label).drop("poi")


def stays_of_trips(trips: DataFrame, labels: DataFrame) -> DataFrame:
    """(uid, stay_seq, location_id, activity_label, start_time, end_time, duration).

    The origin of the first trip is a stay over that trip's own time; each trip's destination
    is a stay from its arrival to the next arrival, the last one an hour long.
    """
    order = Window.partitionBy("uid").orderBy("trip_seq")
    t = trips.withColumn("next_et", F.lead("et").over(order)).withColumn("is_last", F.lead("trip_seq").over(order).isNull()).withColumn("is_first", F.lag("trip_seq").over(order).isNull())
    end = F.when(F.col("is_last"), F.col("et") + LAST_STAY_S).otherwise(F.col("next_et"))
    arrival = F.struct((F.col("trip_seq") + 1).alias("stay_seq"), F.col("to_id").alias("location_id"), F.col("et").alias("start_time"), end.alias("end_time"))
    origin = F.struct(F.col("trip_seq").alias("stay_seq"), F.col("from_id").alias("location_id"), F.col("st").alias("start_time"), F.col("et").alias("end_time"))
    rows = t.select("uid", F.explode(F.when(F.col("is_first"), F.array(origin, arrival)).otherwise(F.array(arrival))).alias("s")).select("uid", "s.*")
    named = rows.join(labels.select("uid", F.col("loc_id").alias("location_id"), "activity_label"), ["uid", "location_id"], "left")
    return named.select("uid", "stay_seq", "location_id", F.coalesce("activity_label", F.lit("unknown")).alias("activity_label"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"))


def unknown_places(trips: DataFrame, labels: DataFrame) -> DataFrame:
    """(uid, trip_seq, location_id): trips with an end that is no place of the person, to be set aside."""
    first = F.row_number().over(Window.partitionBy("uid").orderBy("trip_seq")) == 1
    t = trips.withColumn("first", first)
    ends = t.select("uid", "trip_seq", F.explode(F.when(F.col("first"), F.array("from_id", "to_id")).otherwise(F.array("to_id"))).alias("location_id"))
    known = labels.select("uid", F.col("loc_id").alias("location_id"))
    return ends.join(known, ["uid", "location_id"], "left_anti").select("uid", "trip_seq", "location_id")


def stays_by_day(stays: DataFrame, zone: str = "Europe/Rome") -> DataFrame:
    """Stays cut at local midnights; a stay keeps the offset that holds at its start.

    Stays without a start or an end are dropped; one that ends before its first midnight
    boundary and before it starts keeps its negative length; one that ends at midnight
    exactly gives nothing on the next day.
    """
    s = stays.where("start_time is not null and end_time is not null").withColumn("off", utc_offset("start_time", zone))
    s = s.withColumn("day0", F.floor((F.col("start_time") + F.col("off")) / DAY_S))
    days = F.ceil((F.col("end_time") + F.col("off")) / DAY_S) - F.col("day0")
    s = s.withColumn("n", days).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    begin = (F.col("day0") + F.col("k")) * DAY_S - F.col("off")
    return s.select(
        "uid", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("day0") + F.col("k")).cast("int")).alias("day_date"), "stay_seq", "location_id", "activity_label",
        F.greatest("start_time", begin).alias("start_time"), F.least(F.col("end_time"), begin + DAY_S).alias("end_time"), begin.alias("day_start"),
    ).withColumn("duration", F.col("end_time") - F.col("start_time"))


def _day():
    return Window.partitionBy("uid", "day_date")


def anchors(days: DataFrame) -> DataFrame:
    """The longest stay of each day away from home, the first of equals."""
    best = F.row_number().over(_day().orderBy(F.desc("duration"), "stay_seq"))
    return days.where("activity_label <> 'home'").withColumn("rn", best).where("rn = 1").drop("rn")


def successions(days: DataFrame) -> DataFrame:
    """Days' stays with ``next_activity`` and ``next_start`` of the same day."""
    order = _day().orderBy("stay_seq", "start_time")
    return days.withColumn("next_activity", F.lead("activity_label").over(order)).withColumn("next_start", F.lead("start_time").over(order))


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """(keys, bin, n, lo, width): equal bins over each group's range, the last one closed.

    A constant group spreads half a unit to both sides.  Counts are aggregated by value range
    (two aggregates with map-side combining), so one large group is no single task's load.
    """
    ends = values.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    j = values.join(ends, keys) if keys else values.crossJoin(F.broadcast(ends))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    return j.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first((F.col("hi") - F.col("lo")) / bins).alias("width"))


def duration_histograms(days: DataFrame, keys: tuple[str, ...] = ("uid", "activity_label")) -> DataFrame:
    """20-bin histograms of stay durations, each day's last stay aside."""
    return histogram(successions(days).where("next_activity is not null"), list(keys), "duration")


def transitions(days: DataFrame, by_user: bool = True) -> DataFrame:
    """(…, from_activity, to_activity, n, prob) of moves within a day."""
    keys = ["uid"] * by_user + ["from_activity"]
    moves = successions(days).where("next_activity is not null").select(*["uid"] * by_user, F.col("activity_label").alias("from_activity"), F.col("next_activity").alias("to_activity"))
    counts = moves.groupBy(*keys, "to_activity").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def transition_matrix(probabilities: DataFrame, labels: list[str]) -> DataFrame:
    """Rows: to; columns: from, of the given labels; 0 where there was no move."""
    return probabilities.groupBy("to_activity").pivot("from_activity", labels).agg(F.first("prob")).na.fill(0.0)


def gap_histogram(days: DataFrame) -> DataFrame:
    """Histogram of positive gaps between stays of a day (none for well-formed stays)."""
    gaps = successions(days).withColumn("gap", F.col("next_start") - F.col("end_time")).where("gap > 0")
    return histogram(gaps, ["uid"], "gap")


def diversity(days: DataFrame) -> DataFrame:
    """How many places serve each of a user's activities."""
    return days.groupBy("uid", F.lower("activity_label").alias("activity")).agg(F.countDistinct("location_id").alias("required"))
