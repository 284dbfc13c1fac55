r"""Line deduplication on a suffix array over line ids.

Every text is a sequence of lines, every line an id of 128 bits; a suffix starts at each line.
Suffixes are sorted by prefix doubling, distributed: level k ranks them by their first 2**k
lines, from the pair of level k - 1 ranks at their start and 2**(k-1) lines on.  Suffixes
whose first 2**k lines occur once drop out of later levels (their place is settled), so each
level is smaller than the one before, and lines that occur once never enter.

Suffixes with equal ranks are a longest-common-prefix interval of that depth; an interval of
any depth m is named by two overlapping ranks, at its start and at m - 2**k lines on.  For
each start, m is the least number of lines with ``min_words`` words.  The interval's earliest
suffix is found by an aggregate (which combines on the map side, so a run that a third of
all documents share is no burden); every other suffix of it starts a repeated run, extended
to its maximal length from the highest level down: into each deeper interval that still
holds an earlier suffix.  The lines of repeated
runs are deleted, so that a run stays where it stands first: in the smallest doc_id, and
there at the first place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, range_bucket, range_cuts, scratch, shuffle_parts, slices, utf8, words_of

MIN_WORDS = 50


def _lines(min_words: int):
    def run(batches):
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(offsets):
                own = raw[offsets[lo] : offsets[hi]]
                at = offsets[lo : hi + 1] - offsets[lo]
                breaks = np.flatnonzero(own == 10)
                per_text = np.searchsorted(breaks, at)  # line ends before each text
                starts = np.insert(breaks + 1, per_text[:-1], at[:-1])  # a text starts a line, so does what follows a line end
                ends = np.insert(breaks, per_text[1:], at[1:])
                n = np.diff(per_text) + 1
                word_at = words_of(own, at)[1]
                seen = np.searchsorted(word_at, np.append(starts, len(own)))
                words = np.searchsorted(word_at, ends) - seen[:-1]
                view = own.tobytes()
                marks = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                first = np.concatenate([[0], np.cumsum(n)])
                need = np.zeros(len(starts), np.int64)
                total = np.concatenate([[0], np.cumsum(words)])
                reach = np.searchsorted(total, total[:-1] + max(1, min_words))  # the line that completes the words
                limit = np.repeat(first[1:], n)
                need = np.where(reach <= limit, reach - np.arange(len(starts)), 0)
                tie = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64).view(np.int64)
                pos = np.arange(len(starts)) - np.repeat(first[:-1], n)
                doc = pa.array([ids[lo + i] for i in range(hi - lo)], pa.int64()).take(pa.array(np.repeat(np.arange(hi - lo), n)))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(np.repeat(tie, n)), pa.array(pos.astype(np.int32)), pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1])), pa.array(need.astype(np.int32))],
                    ["doc", "tie", "pos", "line", "low", "need"],
                )

    return run


def _numbered(lines: DataFrame) -> DataFrame:
    """(base, doc, tie): the number of each document's first line in the whole sequence.

    Documents are ordered by id (null last) and a digest of the text.  The running sum goes
    over ranges of ids, then within each.
    """
    docs = lines.groupBy("doc", "tie").agg((F.max("pos") + 1).cast("long").alias("n"))
    docs = materialize(docs, "docs")
    cuts = range_cuts(docs, "doc", shuffle_parts(lines.sparkSession))
    part = F.when(F.col("doc").isNull(), F.lit(len(cuts) + 1)).otherwise(range_bucket(F.col("doc"), cuts))
    docs = docs.withColumn("part", part)
    sums = docs.groupBy("part").agg(F.sum("n").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("part").orderBy(F.col("doc").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(order), F.lit(0))
    return docs.withColumn("within", within).join(F.broadcast(sums), "part").select((F.col("ahead") + F.col("within")).alias("base"), "doc", "tie")  # a row for each range


@dataclass
class SuffixLevels:
    """(g, base, rank, first) of each level: suffix g of document base, its rank by 2**k lines
    and the earliest suffix of that rank; only ranks that at least two suffixes share."""

    levels: list[DataFrame]

    @property
    def top(self) -> int:
        return len(self.levels) - 1


def suffix_levels(lines: DataFrame) -> SuffixLevels:
    """Prefix doubling over (g, base, line, low): global line number, document, line id in two halves."""
    groups = lines.groupBy("line", "low").agg(F.count("*").alias("n"), F.min("g").alias("first")).where("n > 1")
    groups = materialize(groups, "lines")
    cuts = range_cuts(groups, "line", shuffle_parts(lines.sparkSession))
    groups = groups.withColumn("part", range_bucket(F.col("line"), cuts))
    sums = groups.groupBy("part").agg(F.sum("n").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("line", "low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = groups.withColumn("within", within).join(F.broadcast(sums), "part").select("line", "low", "first", (F.col("ahead") + F.col("within") + 1).alias("rank"))
    levels = [materialize(lines.join(ranks, ["line", "low"]).select("g", "base", "rank", "first"), "level")]
    step = 1
    while levels[-1].limit(1).count():
        now = levels[-1].select("g", "base", "rank")
        ahead = now.select((F.col("g") - step).alias("g"), "base", F.col("rank").alias("next"))
        pairs = materialize(now.join(ahead, ["g", "base"]), "pairs")
        groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min("g").alias("first")).where("n > 1")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = groups.withColumn("refined", F.col("rank") + before)
        levels.append(materialize(pairs.join(groups, ["rank", "next"]).select("g", "base", F.col("refined").alias("rank"), "first"), "level"))
        step *= 2
    return SuffixLevels(levels[:-1])


def repeated_runs(lines: DataFrame, found: SuffixLevels, longest: bool = False) -> DataFrame:
    """(base, g, length): runs to delete, from (g, base, need) and the suffix levels.

    A run is extended against its first copy, or with ``longest`` against all earlier copies.
    """
    spark = lines.sparkSession
    members = spark.createDataFrame([], "g long, base long, first long, need int")
    wanted = lines.where("need > 0")
    most = wanted.agg(F.max("need").alias("m")).first()["m"] or 0
    for k, level in enumerate(found.levels[: int(most).bit_length()]):  # a plan for each level keeps plans small
        own = wanted.where((F.col("need") >= 1 << k) & (F.col("need") < 2 << k))
        own = own.join(level.select("g", F.col("rank").alias("head")), "g")
        shifted = own.withColumn("at", F.col("g") + F.col("need") - (1 << k))
        tails = level.select(F.col("g").alias("at"), F.col("rank").alias("tail"))
        named = shifted.join(tails, "at").select("g", "base", "need", "head", "tail")
        firsts = named.groupBy("need", "head", "tail").agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = named.join(firsts, ["need", "head", "tail"])
        members = members.union(materialize(again.select("g", "base", "first", "need"), "again"))
    # Only a run's last start can reach beyond what its later starts cover.
    later = members.where("first < g").select((F.col("g") - 1).alias("g"), "base", F.lit(1).alias("more"))
    marked = members.join(later, ["g", "base"], "left")
    marked = marked.select("g", "base", "first", F.col("need").cast("long").alias("length"), (F.col("first") < F.col("g")).alias("again"), F.col("more").isNotNull().alias("more"))
    marked = materialize(marked, "starts")
    inner = marked.where("again and more").select("base", "g", "length")
    copy = F.lit(True) if longest else F.col("g") == F.col("first")
    rows = marked.select("g", "base", "first", "length", copy.alias("copy"), F.expr("again and not more").alias("last"))
    ends = _extended(materialize(_with_ends(rows), "rows"), found)
    return inner.union(ends.select("base", "g", "length"))


def _with_ends(rows: DataFrame) -> DataFrame:
    """The rows of intervals that still have a last start."""
    live = rows.where("last").select("first", "length").distinct()
    return rows.where("copy or last").join(live, ["first", "length"], "left_semi").select("g", "base", "first", "length", "copy", "last")


def _extended(rows: DataFrame, found: SuffixLevels) -> DataFrame:
    """The last starts of (g, base, first, length, copy, last) at their maximal length.

    An interval is named by its length and its first copy.  From the highest level down, those
    suffixes of it that go on alike for 2**k lines form a deeper one; last starts behind that
    one's first copy move into it, copies are in both.
    """
    for k in range(found.top, -1, -1):
        level = found.levels[k].select(F.col("g").alias("p"), "base", F.col("rank").alias("next"))
        ahead = rows.withColumn("p", F.col("g") + F.col("length")).join(level, ["p", "base"])
        groups = ahead.groupBy("first", "length", "next").agg(F.min(F.when(F.col("copy"), F.col("g"))).alias("deeper"), F.max(F.when(F.col("last"), F.col("g"))).alias("far")).where("deeper < far")
        moved = ahead.join(groups, ["first", "length", "next"]).select("g", "base", "first", "length", "deeper", "copy", F.expr("last and g > deeper").alias("gains"))
        moved = materialize(moved, "moved")
        if not moved.limit(1).count():
            continue
        grown = moved.select("g", "base", F.col("deeper").alias("first"), (F.col("length") + (1 << k)).alias("length"), "copy", F.col("gains").alias("last"))
        left = moved.where("gains").select("g", "first", "length", "gains")
        stay = rows.join(left, ["g", "first", "length"], "left").select("g", "base", "first", "length", "copy", F.expr("last and gains is null").alias("last"))
        done = materialize(stay.union(grown), "rows")
        rows = materialize(_with_ends(done), "rows")
    return rows.where("last")


def _delete(batches):
    for batch in batches:
        texts, totals, gone = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts = (text or "").split("\n")
            drop = np.zeros(len(parts) + 1, np.int64)
            for r in runs or ():
                drop[r["at"]] += 1
                drop[min(len(parts), r["at"] + r["length"])] -= 1
            keep = np.cumsum(drop[:-1]) == 0
            totals.append(len(parts))
            gone.append(int((~keep).sum()))
            texts.append(text if keep.all() else "\n".join(p for p, k in zip(parts, keep.tolist(), strict=True) if k))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", longest: bool = False) -> DataFrame:
    """Delete later copies of maximal repeated line runs of at least ``min_words`` words.

    Returns all columns of ``docs``, ``text_col`` without the deleted lines, and
    (n_lines long, n_removed long), which replace input columns of these names.  Every run of lines with that many words that occurs again
    (also within one document, also overlapping itself) keeps its first copy in the order of
    ids.  A null text stays null and counts one empty line; empty texts have one empty line;
    blank lines have no words and go only as part of a run.  Rows of the same id and text are
    one document: they keep their rows and lose the same lines.  A null id orders last.
    An empty table gives an empty result.
    """
    with scratch() as keep:  # what is left to read is the lists alone
        narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        cut = materialize(narrow.mapInArrow(_lines(min_words), "doc long, tie long, pos int, line long, low long, need int"), "cut")
        cut = cut.distinct() if narrow.groupBy("doc").count().where("count > 1").limit(1).count() else cut
        numbered = materialize(_numbered(cut), "numbered")
        again = cut.groupBy("line", "low").agg(F.count("*").alias("n")).where("n > 1").select("line", "low")
        lines = cut.join(again, ["line", "low"], "left_semi")
        bases = numbered.withColumnRenamed("doc", "nd").withColumnRenamed("tie", "nt")
        lines = lines.join(bases, lines.doc.eqNullSafe(bases.nd) & (lines.tie == bases.nt))
        lines = materialize(lines.select((F.col("base") + F.col("pos")).alias("g"), "base", "line", "low", "need"), "repeated")
        runs = repeated_runs(lines, suffix_levels(lines), longest)
        lists = runs.groupBy("base").agg(F.collect_list(F.struct((F.col("g") - F.col("base")).cast("int").alias("at"), F.col("length").cast("int").alias("length"))).alias("runs"))
        lists = keep(materialize(lists.join(numbered, "base").select(F.col("doc").alias("run_doc"), F.col("tie").alias("run_tie"), "runs"), "runs"))

    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = [F.col(f"`{c}`") for c in columns if c != text_col]
    wide = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("run_key"))
    row, text, number = T.StructField("row", wide.schema["row"].dataType), T.StructField("text", T.StringType()), T.LongType()
    tied = wide.mapInArrow(_tied, T.StructType([row, text, T.StructField("run_key", number), T.StructField("tie", number)]))
    # Always by shuffle: the lists grow with the corpus, so small runs shall behave as large ones do.
    joined = tied.join(lists.hint("merge"), tied.run_key.eqNullSafe(lists.run_doc) & (tied.tie == lists.run_tie), "left").select("row", "text", "runs")
    out = joined.mapInArrow(_delete, T.StructType([row, text, T.StructField("n_lines", number), T.StructField("n_removed", number)]))
    picked = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns]
    return out.select(*picked, F.col("n_lines"), F.col("n_removed"))


def _tied(batches):
    for batch in batches:
        offsets, raw = utf8(batch.column(1))
        view = raw.tobytes()
        ties = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(ties, np.uint64).view(np.int64))], [*batch.schema.names, "tie"])
