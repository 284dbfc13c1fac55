"""N-gram Jaccard self-join by parity sketches.

Method.  A text's word shingles are hashed; each hash flips bits of a sketch that is cut
into blocks (the hash's high bits choose the block, the rest is xor-ed into it).  A shingle
that only one of two texts has changes one block, so the number of blocks that differ is a
lower bound of the symmetric difference.  Texts whose sets hold ``a <= b`` shingles and reach
the wanted similarity t differ in at most ``D = (1 - t) / t * a`` shingles; a band of sizes
therefore gets ``D + 1 + E`` blocks, and at least ``E + 1`` blocks of two linked texts agree.
Blocks that no shingle reached say nothing; a text with at most ``E`` of them needs no others,
and the few texts with more also offer their empty blocks, so no link is lost.  A text offers
its blocks in each band that a linked smaller text may have.

Candidates.  Texts with equal sets are one text from the start, named by the smallest id.  Texts
that share a block meet under one key.  Nobody emits all pairs of a key: in each round a key
names leaders, and every member is checked against these alone.  The links found are closed
into components, and a key is done when all its members that have not led are in one component.
The first leader of a key is its first member, the next one the member with the most links,
which is the text that copies were made of, so that groups of near copies close at once.  Then
all members of keys with few lead.  Members of keys that still hold many share something common
(a passage, say) and meet by rare shingles instead: in an order of all shingles by their number
of texts, two linked texts have one in common among the first ``n - ceil(t * n) + 1`` of each, so
these are their keys from then on, and texts that share no more than a passage have none.  Where such
a key holds many too, 4, 16, ... lead until it is closed: log m rounds for m members, and m * m / 2
comparisons of sketches at the most, if m texts share even their rarest shingles and are not linked.
Texts that share a passage meet under many keys of one round.  Each brings the smallest keys in
which it leads and in which it is a member (``SMALLEST`` of each), and a pair is left to the
smallest key that both show, so it leaves the join once instead of once a key; a pair that
shows none in common leaves it at each of its keys.
A folded 256-bit parity sketch, in the join's condition, discards pairs whose Hamming distance
already exceeds the bound, and what is left is verified on the full shingle sets.

Result: one row per document with its component, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast, mix64, shuffle_parts, slices, utf8, words_of
from .components import connected_components

BAND_RATIO = 1.5
SKETCH_WORDS = 4
FEW = 64  # members of a key that may all lead
SMALLEST = 8  # keys of a round that a text shows to its partners
ORDERED = 1 << 19  # common shingles that are ordered by their number of texts; others come before them
_SKETCH = ", ".join(f"s{i} long" for i in range(SKETCH_WORDS))


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, n: int, fold_ascii: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams.

    With fewer than ``n`` words the whole sequence is one shingle; without words: none.
    """
    words, starts, _ = words_of(raw, offsets, fold_ascii)
    borders = np.searchsorted(starts, offsets)
    mul = np.uint64(0xA0761D6478BD642F | 1)
    rolled = words.copy()
    if len(words) >= n:
        rolled = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            rolled = mix64(rolled * mul + words[j : len(words) - n + 1 + j])
    for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        count = hi - lo
        if count >= n:
            yield np.unique(rolled[lo : hi - n + 1])
        elif count:
            one = words[lo : lo + 1].copy()
            for j in range(lo + 1, hi):
                one = mix64(one * mul + words[j : j + 1])
            yield mix64(one + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Bands of set sizes with their bounds, block counts and spare blocks."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("similarity must be in (0, 1]")
        self.num, self.den = num, den
        self.low = [1]
        self.blocks: list[tuple[int, int]] = []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            lo = self.low[-1]
            nxt = max(lo + 1, int(np.ceil(lo * BAND_RATIO)))
            bound = (self.den - self.num) * (nxt - 1) // self.num
            spare = 0
            for _ in range(6):
                empty = (bound + 1 + spare) * np.exp(-lo / (bound + 1 + spare))
                spare = int(np.ceil(empty + 4 * np.sqrt(empty))) if bound else 0
            self.low.append(nxt)
            self.blocks.append((bound + 1 + spare, spare))

    def of(self, size: int) -> range:
        """Bands in which a set of ``size`` can meet a linked one."""
        self._grow(size)
        least = -(-self.num * size // self.den)
        first = int(np.searchsorted(self.low, least, "right")) - 1
        return range(first, int(np.searchsorted(self.low, size, "right")))


def block_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys a set of sorted distinct hashes offers in all of its bands."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    out = []
    inner = mix64(tokens)
    high = tokens >> np.uint64(32)
    for band in bands.of(len(tokens)):
        blocks, spare = bands.blocks[band]
        at = (high * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        parity = np.bitwise_xor.reduceat(inner, starts)
        place = at[starts] + np.uint64(band << 40)
        out.append(mix64(parity + mix64(place + np.uint64(1))))
        if blocks - len(starts) > spare:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at[starts], assume_unique=True)
            out.append(mix64(mix64(empty + np.uint64((band << 40) + (1 << 63)))))
    return np.concatenate(out)


def folded_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of ``64 * SKETCH_WORDS`` counters, as 64-bit words."""
    bits = np.bincount((mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def wide_sketch(tokens: np.ndarray) -> bytes:
    """Parity of at least four counters for each token: a power of two of bits, 64 or more."""
    bits = max(64, 1 << (4 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = (mix64(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded onto the shorter."""
    p, q = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _summaries(n: int, num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                keys, sizes, marks, sketches, wides = [], [], [], [], []
                for tokens in shingle_sets(at, raw[offsets[lo] : offsets[hi]], n):
                    keys.append(block_keys(tokens, bands).view(np.int64))
                    sizes.append(len(tokens))
                    marks.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    sketches.append(folded_sketch(tokens))
                    wides.append(wide_sketch(tokens))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                wide = np.array(sketches, np.uint64).view(np.int64)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(wides, pa.binary())] + [pa.array(wide[:, i]) for i in range(SKETCH_WORDS)],
                    ["id", "n", "mark", "keys", "wide"] + [f"s{i}" for i in range(SKETCH_WORDS)],
                )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                rows = [t.tobytes() for t in shingle_sets(at, raw[offsets[lo] : offsets[hi]], n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(rows, pa.binary())], ["id", "tokens"])

    return run


def _near(num: int, den: int):
    def run(batches):
        for batch in batches:
            sizes = np.add(batch.column(2).to_numpy(), batch.column(3).to_numpy()) * (den - num)
            keep = [sketch_distance(x, y) * (den + num) <= most for x, y, most in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(p) + len(q)
                shared = both - len(np.unique(np.concatenate([p, q])))
                keep.append(den * shared >= num * (both - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose word n-gram sets have ``den * |both| >= num * |either|``.

    Returns (id_col, n_shingles long, component_id long): the smallest id reachable by links.
    Words are maximal runs of other characters than space and controls 9 to 13, with A-Z
    lower-cased.  A text with fewer than ``n`` words is one shingle; a null, empty or blank
    text has none and links with nothing.  Rows that repeat an id link through that id and
    each keep a row, whatever their texts.  Rows with a null id get a null component.  Other
    columns are ignored, so clashing names do no harm.  An empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if narrow.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        # Rows get numbers of their own; those of one id are linked, and classes named by ids again.
        rows = materialize(narrow.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "rows")
        named = rows.select("row", "id")
        same = named.where("id is not null").join(named.where("id is not null").groupBy("id").agg(F.min("row").alias("b")), "id").select(F.col("row").alias("a"), "b")
        found = materialize(_classes(rows.where("id is not null").select(F.col("row").alias("id"), "text"), n, num, den, same), "classes")
        found = found.withColumnRenamed("id", "row").join(named, "row")
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        found = found.join(least, "component").select("id", "n", F.col("least").alias("component"))
        unnamed = rows.where("id is null").select("id", "text").mapInArrow(_counts(n), "id long, n long")
        found = found.union(unnamed.select("id", "n", F.lit(None).cast("long")))
    else:
        found = _classes(narrow, n, num, den)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _classes(narrow: DataFrame, n: int, num: int, den: int, known: DataFrame | None = None) -> DataFrame:
    """(id, n, component) of (id, text); ids are distinct or null, ``known`` are links (a, b) besides."""
    made = narrow.mapInArrow(_summaries(n, num, den), f"id long, n long, mark binary, keys array<long>, wide binary, {_SKETCH}")
    made = materialize(made, "sketch")
    # Equal sets have equal marks of 128 bits; the smallest id stands for them.
    some = made.where("n > 0 and id is not null")
    firsts = materialize(some.groupBy("n", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "firsts")
    copies = some.select("id", "n", "mark").join(firsts.where("copies > 1").select("n", "mark", "rep"), ["n", "mark"])
    copies = materialize(copies.where("id <> rep").select("id", "rep"), "copies")
    discard(firsts)
    few = maybe_broadcast(copies.select("id"), copies.count())
    reps = some.join(few, "id", "left_anti")
    facts, sketches = reps.drop("keys", "wide", "mark"), reps.select("id", "n", "wide")

    # One streaming pass over each key's members in order: the first member leads.
    flat = reps.select("id", F.explode("keys").alias("key"))
    led = flat.withColumn("lead", F.first("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    members = materialize(led.where("id <> lead"), "members")
    pairs = members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = _verify(_near_pairs(pairs, facts, num, den), sketches, narrow, n, num, den)
    first_pass = members
    if known is not None:  # links to a copy are links to what stands for it
        named = copies.withColumnRenamed("id", "x")
        side = lambda df, c: df.join(named.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
        links = materialize(links.union(side(side(known, "a"), "b").select("a", "b").where("a <> b")).distinct(), "links")
    parts = materialize(connected_components(links), "parts")

    members, hubs, spent = members.select("key", "id"), 1, [first_pass]
    while True:
        opened = materialize(_open_members(members, parts, links), "open")
        discard(*spent)
        spent = [opened]
        if hubs == 4 and opened.where(F.col("size") > FEW).limit(1).count():
            rare = _rare_members(opened.where(F.col("size") > FEW).select("id").distinct(), narrow, n, num, den)
            opened = materialize(_open_members(opened.where(F.col("size") <= FEW).select("key", "id").union(rare), parts, links), "open")
            discard(*spent, rare)
            spent = [opened]
        if not opened.limit(1).count():
            break
        leaders = F.when(F.col("size") <= FEW, F.col("size")).otherwise(hubs) if hubs > 1 else F.lit(1)
        numbered = opened.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "id")))
        numbered = numbered.withColumn("leads", F.col("rn") <= leaders)
        ranked = materialize(numbered.select("key", "id", "part", "size", "leads"), "ranked")
        met = materialize(facts.join(_smallest_keys(ranked), "id"), "met")
        more = _verify(_led_rows(ranked, met, num, den).distinct(), sketches, narrow, n, num, den)
        discard(met)
        spent += [ranked, more]
        if more.limit(1).count():
            spent += [links, parts]
            links = materialize(links.union(more).distinct(), "links")
            # What was closed stays closed: only components meet.
            named = parts.select("id", "component")
            ends = more.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left")
            ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            merged = materialize(connected_components(ends), "merged")
            known_ids = parts.join(merged.toDF("component", "into"), "component", "left").select("id", F.coalesce("into", "component").alias("component"))
            new_ids = merged.join(parts.select("id"), "id", "left_anti")
            parts = materialize(known_ids.union(new_ids.select("id", "component")), "parts")
            discard(merged)
        members, hubs = ranked.where(~F.col("leads")).select("key", "id"), hubs * 4
    discard(*spent, links)
    of_rep = parts.toDF("rep", "component")
    out = made.select("id", "n").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return out.join(of_rep, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def _open_members(members: DataFrame, parts: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, part, degree, size): members of keys that are not in one component yet.

    ``degree`` counts a member's links, ``size`` the key's members.
    """
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    known = parts.join(degree, "id", "left").select("id", F.col("component").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"))
    every = members.join(maybe_broadcast(known, parts.count()), "id", "left").select("key", "id", F.coalesce("part", "id").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"))
    keys = every.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
    return every.join(keys, "key").select("key", "id", "part", "degree", "size")


def _rare_members(ids: DataFrame, narrow: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, id): the rarest shingles of the texts ``ids``, as many as two linked ones need to share one.

    Shingles are ordered by the number of texts that hold them.  Only the ``ORDERED`` most common
    ones need their number for that; any order that all texts use is right.
    """
    spark = narrow.sparkSession
    wanted = materialize(ids, "wanted")
    sets = materialize(_of(wanted, narrow.where("id is not null")).select("id", "text").mapInArrow(_sets(n), "id long, tokens binary"), "sets")
    parts = shuffle_parts(spark)
    dealt = sets.mapInArrow(_dealt_counts(parts), "bucket int, tokens binary, counts binary").repartition(parts, "bucket")
    most = dealt.mapInArrow(_most_common(-(-ORDERED // parts)), "tokens binary, counts binary, whole boolean").collect()
    tokens = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.tokens, np.uint64) for r in most]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.counts, np.int64) for r in most]])
    order = np.argsort(tokens)
    common = spark.sparkContext.broadcast((tokens[order], counts[order], all(r.whole for r in most)))
    flat = sets.mapInArrow(_rarest(common, num, den), "id long, keys array<long>").select(F.explode("keys").alias("key"), "id")
    # A key of one text leads to nothing.
    flat = flat.withColumn("texts", F.count("*").over(Window.partitionBy("key"))).where("texts > 1")
    made = materialize(flat.select("key", "id"), "rare")
    common.destroy()
    discard(wanted, sets)
    return made


def _packed_sets(batches, size: int = 1 << 22):
    """(ids, ends, tokens) of a few (id, tokens) rows at a time; ``ends`` are the sets' borders, from 0."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        sizes = np.array([len(t.as_buffer()) for t in column], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for lo, hi in slices(ends, size):
            tokens = np.frombuffer(b"".join(column[lo:hi].to_pylist()), np.uint64)
            yield batch.column(0)[lo:hi], (ends[lo : hi + 1] - ends[lo]) // 8, tokens


def _dealt_counts(parts: int):
    """Distinct shingles with their number of texts, many in a row, dealt by hash."""

    def run(batches):
        for _, _, tokens in _packed_sets(batches):
            tokens, counts = np.unique(tokens, return_counts=True)
            bucket = tokens % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            cut = lambda x: [v.tobytes() for v in np.split(x[order], starts[1:])]
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(cut(tokens), pa.binary()), pa.array(cut(counts.astype(np.int64)), pa.binary())], ["bucket", "tokens", "counts"])

    return run


def _most_common(most: int):
    """The shingles of more than one text, at most ``most`` of a partition's, and whether these are all."""

    def run(batches):
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            some = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(1)]
            more = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(2)]
            tokens, at = np.unique(np.concatenate([tokens, *some]), return_inverse=True)
            total = np.zeros(len(tokens), np.int64)
            np.add.at(total, at, np.concatenate([counts, *more]))
            counts = total
        order = np.flatnonzero(counts > 1)
        order = order[np.lexsort((tokens[order], -counts[order]))]
        top = order[:most]
        if len(tokens):
            yield pa.RecordBatch.from_arrays([pa.array([tokens[top].tobytes()], pa.binary()), pa.array([counts[top].tobytes()], pa.binary()), pa.array([len(top) == len(order)])], ["tokens", "counts", "whole"])

    return run


def _rarest(common, num: int, den: int):
    """Of each set of m shingles the first m - ceil(num * m / den) + 1, by their number of texts.

    A linked text shares ceil(num * m / den) or more, so the first that both hold is among these
    in both.  Those that are known to be in no other text take their place and are left out.
    """

    def run(batches):
        known, counts, whole = common.value
        for ids, ends, tokens in _packed_sets(batches):
            texts = np.zeros(len(tokens), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                texts = np.where(known[at] == tokens, counts[at], 0)
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((tokens, texts, row))  # ends stay where they are
            first = np.arange(len(tokens)) - ends[row] < (sizes - -(-num * sizes // den) + 1)[row]
            taken = order[first & ((texts[order] > 0) | (not whole))]
            to = np.concatenate([[0], np.cumsum(np.bincount(row[taken], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(to), pa.array(tokens[taken].view(np.int64)))], ["id", "keys"])

    return run


def _smallest_keys(ranked: DataFrame) -> DataFrame:
    """(id, lead_keys, keys): the smallest keys in which a text leads and in which it is a member."""
    few = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, SMALLEST)
    return ranked.groupBy("id").agg(few(F.when(F.col("leads"), F.col("key"))).alias("lead_keys"), few("key").alias("keys"))


def _counts(n: int):
    def run(batches):
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                sizes = [len(t) for t in shingle_sets(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes, pa.int64())], ["id", "n"])

    return run


_FACTS = ["n", *[f"s{i}" for i in range(SKETCH_WORDS)]]


def _side(facts: DataFrame, p: str, as_id: str, *more: str) -> DataFrame:
    return facts.select(F.col("id").alias(as_id), *[F.col(c).alias(p + c) for c in (*_FACTS, *more)])


def _fits(num: int, den: int):
    distance = sum((F.bit_count(F.col(f"xs{i}").bitwiseXOR(F.col(f"ys{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return _within(F.col("xn"), F.col("yn"), distance, num, den)


def _near_pairs(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and folded sketches allow a link."""
    return pairs.join(_side(facts, "x", "a"), "a").join(_side(facts, "y", "b"), "b").where(_fits(num, den)).select("a", "b")


def _led_rows(ranked: DataFrame, met: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a key's leaders with its members in other components, as far as sketches allow a link.

    ``met`` holds the texts' facts and :func:`_smallest_keys`.  A pair waits for no key but a smaller one that has it too, so its smallest key always gives it.
    """
    x = ranked.where("leads").select("key", F.col("id").alias("lead"), F.col("part").alias("lead_part")).join(_side(met, "x", "lead", "lead_keys"), "lead")
    y = ranked.select(F.col("key").alias("ykey"), "id", "part", "leads").join(_side(met, "y", "id", "keys"), "id")
    once = ~F.col("leads") | (F.col("lead") < F.col("id"))
    here = F.coalesce(F.array_min(F.array_intersect("xlead_keys", "ykeys")) >= F.col("key"), F.lit(True))
    j = x.join(y, (F.col("key") == F.col("ykey")) & (F.col("lead_part") != F.col("part")) & once & _fits(num, den) & here)
    return j.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))


def _within(p, q, distance, num: int, den: int):
    """Whether sizes ``p``, ``q`` and a lower bound of the difference allow a link."""
    return (F.least(p, q) * den >= F.greatest(p, q) * num) & (distance * (den + num) <= (p + q) * (den - num))


def _verify(pairs: DataFrame, sketches: DataFrame, narrow: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets link.

    Sketches that are wide for large sets come first; only documents of pairs that pass have
    their sets read again.
    """
    near = materialize(pairs, "near")
    wanted = _ends(near)
    wide = _of(wanted, sketches)
    both = near.join(wide.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a").join(wide.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b")
    doubt = materialize(both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_near(num, den), "a long, b long"), "doubt")
    discard(near, wanted)
    if not doubt.limit(1).count():
        return doubt
    wanted = _ends(doubt)
    sets = materialize(_of(wanted, narrow.where("id is not null")).select("id", "text").mapInArrow(_sets(n), "id long, tokens binary"), "sets")
    joined = doubt.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    links = materialize(joined.select("a", "b", "ta", "tb").mapInArrow(_linked(num, den), "a long, b long"), "links")
    discard(doubt, wanted, sets)
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in ``pairs``, written."""
    return materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")


def _of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``rows`` (id, ...) of ``wanted`` documents; their ids are broadcast while few."""
    return rows.join(maybe_broadcast(wanted, wanted.count()), "id", "left_semi")
