"""A quality classifier on supervised subword embeddings.

A text is a bag of hashed words, word 2-grams and character n-grams.  Every bucket of the hash
has a learned vector; a document is the average of its buckets' vectors, in which n occurrences
of a bucket weigh as much as the square root of n.  A softmax layer turns that
into class probabilities, and both are trained by plain stochastic gradient descent in numpy
on a bounded, documented sample of labelled rows.  Averaging and the layer are linear, so the
learned vectors fold into one number per bucket; scoring a text is the logistic function of
the average of its buckets' numbers, over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, slices, utf8, words_of

TRAIN_ROWS = 5000  # labelled rows that a model is fitted on, chosen by a hash of their id
BITS = 15
GRAMS = (2, 4)  # lengths of character n-grams
TEXTS = 32


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, and the texts' borders among them."""
    words, starts, _ = words_of(raw, offsets)
    text_of = np.searchsorted(offsets[1:], starts, "right")
    parts = [(words, np.searchsorted(starts, offsets))]
    pairs = np.flatnonzero(text_of[1:] == text_of[:-1]) if len(words) else np.zeros(0, np.int64)
    both = mix64(words[pairs] * np.uint64(0xA0761D6478BD6431) + words[pairs + 1])
    parts.append((both, np.searchsorted(starts[pairs], offsets)))
    # Code points: bytes that do not continue a character start one.
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    chars = mix64(_code_points(raw, heads))
    borders = np.searchsorted(heads, offsets)
    for n in GRAMS:
        k = len(chars) - n + 1
        if k <= 0:
            continue
        rolled = chars[:k].copy()
        for j in range(1, n):
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            rolled += chars[j : j + k]
        inside = np.ones(k, bool)  # n-grams that stay within their text
        for j in range(1, n):
            at = borders[1:-1] - j
            inside[at[(at >= 0) & (at < k)]] = False
        kept = np.flatnonzero(inside)
        parts.append((mix64(rolled[kept] + np.uint64(n)), np.searchsorted(kept, borders)))
    # Interleave by text: all features of a text lie together.
    size = [b[1:] - b[:-1] for _, b in parts]
    ends = np.concatenate([[0], np.cumsum(np.sum(size, axis=0))])
    out = np.empty(ends[-1], np.int32)
    at = ends[:-1].copy()
    for (values, border), n in zip(parts, size, strict=True):
        own = np.arange(border[0], border[-1]) + np.repeat(at - border[:-1], n)
        out[own] = (values[border[0] : border[-1]] >> np.uint64(64 - BITS)).astype(np.int32)
        at += n
    return out, ends


def _code_points(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A number for each character that starts at ``heads`` (its bytes, not decoded)."""
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    wide = padded[heads].astype(np.uint64)
    more = wide >= 0xC0
    at = heads[more]
    wide[more] = wide[more] << np.uint64(8) | padded[at + 1]
    for lead, k in ((0xE0, 2), (0xF0, 3)):
        longer = padded[heads] >= lead
        wide[longer] = wide[longer] << np.uint64(8) | padded[heads[longer] + k]
    return wide


@dataclass(frozen=True)
class Model:
    """Folded weights: a number for each bucket and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(label 1) of each text; a text without features gets the bias alone."""
        buckets, ends = features(raw, offsets)
        out = []
        for lo in range(0, len(ends) - 1, TEXTS):  # a table of counts for a few texts at a time
            cut = ends[lo : lo + TEXTS + 1]
            size = np.diff(cut)
            key = buckets[cut[0] : cut[-1]] + np.repeat(np.arange(len(size)) << BITS, size)
            counts = np.bincount(key, minlength=len(size) << BITS).reshape(len(size), 1 << BITS)
            out.append((np.sqrt(counts) * self.weights).sum(axis=1) / np.maximum(size, 1))
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]) + self.bias, -60, 60)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = 8, epochs: int = 12, rate: float = 1.0, spread: float = 50.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over bags (buckets, shares in the average), one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            buckets, share = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(dim, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, hidden)
            bias -= now * 0.1 * p
            if len(buckets):
                # The average spreads a step over all features; `spread` undoes part of that.
                vectors[buckets] -= np.outer(share * np.float32(now * min(len(buckets), spread)), back)
    fold = layer[1] - layer[0]
    return Model((vectors @ fold).astype(np.float32), float(bias[1] - bias[0]))


def bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text, and the share of each in its average."""
    own, counts = np.unique(buckets, return_counts=True)
    return own.astype(np.uint16), (np.sqrt(counts) / max(1, len(buckets))).astype(np.float32)


def _fit(batches):
    rows = []
    for batch in batches:
        offsets, raw = utf8(batch.column(1))
        keys, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in slices(offsets):
            buckets, ends = features(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows += [(keys[lo + i], *bag(buckets[ends[i] : ends[i + 1]]), int(labels[lo + i])) for i in range(hi - lo)]
    rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
    model = train([(r[1], r[2]) for r in rows], [r[3] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from (id, text, label): at most ``rows`` rows, those of the smallest id hashes.

    The rows are few by that bound, so one task holds their bags and trains.
    """
    few = labelled.where("label is not null").select(F.xxhash64("id").alias("h"), "text", F.col("label").cast("int").alias("label"))
    got = few.orderBy("h", "label").limit(rows).repartition(1).mapInArrow(_fit, "weights binary, bias double").collect()
    return Model(np.frombuffer(bytes(got[0]["weights"]), np.float32), got[0]["bias"]) if got else Model(np.zeros(1 << BITS, np.float32), 0.0)


def _score(weights: bytes, bias: float):
    def run(batches):
        model = Model(np.frombuffer(weights, np.float32), bias)
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            parts = [model.scores(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text; null reads as empty."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_score(model.weights.tobytes(), model.bias), "doc_id long, score double")


def held_out(doc_id) -> F.Column:
    """Rows that never teach: the crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality`` from the rows that are not held out."""
    taught = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull())
    chosen = materialize(taught.orderBy(F.xxhash64("id"), "label").limit(rows), "taught")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return fit(texts.join(F.broadcast(chosen), "id"), rows)  # broadcast: `rows` rows of two numbers


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Only texts enter a score.  Null, empty and blank texts get the score that their (few or
    no) features give; repeated rows keep their rows; rows with a null id are scored and
    count as not held out; with no labels every score is 0.5.  Other columns are ignored.
    """
    scored = score(docs, fit_quality(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS, taught_by: DataFrame | None = None) -> DataFrame:
    """The documents whose score reaches ``threshold``, in their own columns.

    ``taught_by``: documents that the labels speak of, if not ``docs``.
    """
    model = fit_quality(docs if taught_by is None else taught_by, labels, rows)
    return docs.where(_score_udf(model)(docs["text"]) >= threshold)


def _score_udf(model: Model):
    weights, bias = model.weights.tobytes(), model.bias

    def scored(texts: pa.Array) -> pa.Array:
        own = Model(np.frombuffer(weights, np.float32), bias)
        offsets, raw = utf8(texts)
        parts = [own.scores(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    # The types as objects: this module's annotations are strings.
    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf("double")(scored)
