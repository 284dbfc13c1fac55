"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Sizes are summed by source; targets share the whole by weight, none above ``max_repeats``
   times its source (:func:`source_targets` solves the water level with two running sums).
2. All sources are cut into blocks of one length, and the mix is a row of slots that take a
   block each.  Slot i takes the point i * A mod P over P (A / P is near the golden ratio, in
   exact integers), mapped through the cumulative targets to a source.  Any run of slots then
   holds each source close to its share.  Slots are ranked within their source.
3. A source's documents are shuffled by a digest of their id and laid end to end, up to
   ``max_repeats`` times over.  The slot of rank r takes the r-th block of that stream; what is
   behind the stream's end gives nothing.  So the schedule alone decides what is taken, and a
   source's words differ from its target by a few blocks.

A source may hold any share of the rows: its documents are dealt by a digest into parts that
grow in number with the rows, running sums go over partial sums and then within a part, and
what is known of each source is broadcast, if few, or joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, maybe_broadcast

# The golden-ratio lattice: slot i lies at (i * STEP mod PERIOD) / PERIOD.
PERIOD = 2_147_483_647
STEP = 1_327_217_885
CELLS = 4096
LARGEST_BLOCK = 2048  # words of a block, unless there would be more than MOST_SLOTS slots
SLOTS_OF_LEAST = 2048  # slots of the source with the least target, if blocks can be so short
MOST_SLOTS = 1 << 22
CHUNK = 65_536
PART_ROWS = 16_384


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, k, source_size, target) for sizes (source, size).

    Sources weigh ``weights`` in code point order, null last, repeating.  Targets share the
    sum of sizes by weight; what exceeds ``max_repeats`` times a source goes to the others.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(by_source).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("k") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    sums = sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("k"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = sums.withColumn("level", rest / heavy).withColumn("n", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("n"))
    level = level.withColumn("level", F.min_by("level", fits).over(every))
    return level.select("source", "k", "source_size", F.round(F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")), 6).alias("target"))


def block_words(total: int, least: float) -> int:
    """Words of a block, for all words and the least target above 0."""
    return max(1, total // MOST_SLOTS, min(LARGEST_BLOCK, int(least) // SLOTS_OF_LEAST))


def schedule(targets: DataFrame, slots: int, sources: int, step: int = STEP) -> DataFrame:
    """(slot, k, rank): which source each slot draws from, and how many it drew before.

    A source that has a target and no slot gets one behind the others.
    """
    spark = targets.sparkSession
    through = F.sum("target").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    spans = targets.withColumn("hi", F.try_divide(through, F.sum("target").over(Window.partitionBy()))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0.0)))
    last = F.col("k") == F.max("k").over(Window.partitionBy())
    spans = spans.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi"))).where("hi > lo")
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spans = spans.select("k", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    i = F.col("id")
    points = spark.range(slots).select(i.alias("slot"), (F.pmod(F.pmod(i, F.lit(PERIOD)) * step, F.lit(PERIOD)) / PERIOD).alias("x"))
    points = points.withColumn("cell", cell(F.col("x")))
    drawn = points.join(maybe_broadcast(spans, sources + CELLS), "cell").where("x >= lo and x < hi").select("slot", "k")
    missing = targets.where("floor(target) > 0").join(drawn.select("k").distinct(), "k", "left_anti")
    drawn = drawn.union(missing.select((F.col("k") + slots).alias("slot"), "k"))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = drawn.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("k", "chunk", ahead.alias("ahead"))
    within = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot"))
    return drawn.withColumn("within", within).join(counts, ["k", "chunk"]).select("slot", "k", (F.col("ahead") + F.col("within") - 1).cast("long").alias("rank"))


def laid_out(sized: DataFrame, targets: DataFrame, rows: int, sources: int) -> DataFrame:
    """``sized`` with its source's columns and the document's offset in the shuffled source."""
    digits = min(7, max(2, math.ceil(math.log(max(rows, 1) / PART_ROWS, 16))))  # of the digest that names a part
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = sized.withColumn("digest", digest).withColumn("part", F.substring("digest", 1, digits))
    named = maybe_broadcast(targets.withColumnRenamed("source", "named"), sources)
    key = key.join(named, key.source.eqNullSafe(named.named)).drop("named")
    parts = key.groupBy("k", "part").agg(F.sum("size").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("k", "part", ahead.alias("ahead"))
    order = Window.partitionBy("k", "part").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("size").over(order), F.lit(0))
    return key.withColumn("within", within).join(parts, ["k", "part"]).withColumn("offset", (F.col("ahead") + F.col("within")).cast("long")).drop("part", "ahead", "within", "digest")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Documents laid out (k, offset, doc_id, size, ...), and the mix: (slot, k, offset, start, words)."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select("doc_id", "source", size.alias("size")), "sized")
    targets = materialize(source_targets(sized, weights, max_repeats), "targets")
    whole = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.count("*").alias("n"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    total, sources = int(whole["t"]), int(whole["n"])
    block = block_words(total, whole["least"] or 0.0)
    slots = schedule(targets, (total + block // 2) // block, sources, step)
    laid = materialize(laid_out(sized, targets, sized.count(), sources), "laid")

    # Documents are met with blocks only as far as their source has slots.
    dealt = slots.groupBy("k").agg(F.count("*").alias("slots"))
    end = F.least(F.col("slots") * block, F.col("source_size") * max_repeats)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    runs = laid.where("size > 0").join(maybe_broadcast(dealt, sources), "k").withColumn("epoch", epochs)
    runs = runs.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("offset")).withColumn("hi", F.least(F.col("lo") + F.col("size"), end)).where("lo < hi")
    pieces = runs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    first = F.greatest(F.col("lo"), F.col("rank") * block)
    words = F.least(F.col("hi"), (F.col("rank") + 1) * block) - first
    pieces = pieces.select("k", "offset", F.col("rank").cast("long").alias("rank"), (first - F.col("lo")).alias("start"), words.alias("words"))
    return laid, pieces.join(slots, ["k", "rank"]).select("slot", "k", "offset", "start", "words")


def mix_slots(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, step: int = STEP) -> DataFrame:
    """The mix itself: (slot, doc_id, start, words), the words that each slot takes of a document.

    Sorted by (slot, start) this is the mix in order; a slot's words are one block, less only
    at the end of a source that is used up.
    """
    laid, mixed = _mixed(docs, weights, max_repeats, step)
    return mixed.join(laid.where("size > 0").select("k", "offset", "doc_id"), ["k", "offset"]).select("slot", "doc_id", "start", "words")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, step: int = STEP) -> DataFrame:
    """Words of each document that the mix takes.

    Input: doc_id, text, source (other columns are ignored).  Returns (doc_id, size long,
    source_size long, target double, taken long) with a row per input row.  A null or blank
    text has size 0 and is never taken; a null source is a source of its own, the last;
    repeated rows are laid out one after another; an empty table gives an empty result.
    No document is taken more than ``max_repeats`` times; reruns agree.
    """
    laid, mixed = _mixed(docs, weights, max_repeats, step)
    taken = mixed.groupBy("k", "offset").agg(F.sum("words").alias("taken"))
    # Documents without words share an offset with the next one and have nothing to take.
    some = laid.where("size > 0").join(taken, ["k", "offset"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return some.union(laid.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long")))


def repeat_by_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, rounded to whole documents.

    A document whose taken words are under half its size drops out, and so does one without
    words, of which nothing can be taken.  Rows that repeat an id are taken alike.  The columns
    stay, whatever their names; an empty table stays empty.
    """
    taken = mix_sources(docs, weights, max_repeats).groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = taken.where("size > 0").select(F.col("doc_id").alias("id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.col("doc_id").alias("key"), F.struct(*docs.columns).alias("row"))
    repeated = rows.join(times, F.col("key").eqNullSafe(F.col("id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("row.*")


ORACLE_SQL = f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
sums as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as k from sized group by source),
weighed as (select *, (k - 1) % 3 + 1 as w, source_size * 3 as cap from sums),
ordered as (
  select *, row_number() over (order by cap / w, k) as n,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed),
leveled as (select *, (select level from ordered where level * w <= cap order by n limit 1) as water from ordered),
targets as (select source, k, source_size, round(least(cast(cap as double), w * water), 6) as target from leveled),
whole as (select cast(sum(source_size) as bigint) as t, count(*) as n from targets),
block as (select greatest(1, t // {MOST_SLOTS}, least({LARGEST_BLOCK}, cast(floor((select min(target) from targets where target > 0)) as bigint) // {SLOTS_OF_LEAST})) as b, t from whole),
spans as (
  select k, coalesce(lag(hi) over (order by k), 0) as lo, case when k = (select max(k) from targets) then 2 else hi end as hi
  from (select k, sum(target) over (order by k rows unbounded preceding) / sum(target) over () as hi from targets)),
points as (
  select i as slot, (((i % {PERIOD}) * {STEP}) % {PERIOD}) / cast({PERIOD} as double) as x
  from block, range((t + b // 2) // b) r(i)),
drawn as (
  select slot, k from points join spans on x >= lo and x < hi
  union all
  select k + 1000000000000, k from targets where floor(target) > 0 and not exists (select 1 from points join spans s on x >= lo and x < hi where s.k = targets.k)),
dealt as (select k, count(*) as slots from drawn group by k),
ends as (select t.k, least(slots * b, source_size * 3) as stop from targets t join dealt using (k), block),
laid as (
  select s.doc_id, s.size, t.k, t.source_size, t.target,
    coalesce(sum(s.size) over (partition by t.k order by md5(coalesce(cast(s.doc_id as varchar), '')), s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as o
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(coalesce((select sum(greatest(0, least(e * source_size + o + size, stop) - (e * source_size + o))) from range(3) r(e), ends where ends.k = laid.k), 0) as bigint) as taken
from laid
"""
