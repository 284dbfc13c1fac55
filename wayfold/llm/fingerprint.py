"""Canonical exact digests of documents.

A text is normalised (NFKC), case-folded, normalised again and its white space folded to
single spaces; the fingerprint is the 128-bit xxhash of the result.  Documents of one digest
are compared byte for byte: the smallest and the largest canonical text of a digest come out
of an aggregate that combines on the map side, so a group of copies with a third of all rows
shrinks to a row per task.  Where they differ, the digest is a collision and the distinct
canonical texts get their own suffixes.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, range_bucket, range_cuts, shuffle_parts


def canonical(text: str | None) -> str:
    """NFKC, case folded, NFKC again, white space folded; null reads as empty."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(folded: str) -> str:
    return xxhash.xxh3_128_hexdigest(folded.encode("utf-8", "surrogatepass"))


def _canonical_rows(batches):
    for batch in batches:
        folded = [canonical(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(t) for t in folded], pa.string()), pa.array(folded, pa.string())], ["id", "digest", "folded"])


def _digest_rows(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(canonical(t)) for t in texts], pa.string())], ["id", "n_chars", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, digest) of every row."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digest_rows, "id long, n_chars long, digest string")


def collisions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(folded, digest, suffix) of digests in ``found`` that stand for different bytes.

    ``docs`` (id, text); ``found`` (id, digest).  Only documents whose digest occurs again
    are read; the list of their ids is broadcast up to a documented number of rows and
    joined by shuffle beyond it.
    """
    again = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    ids = materialize(found.join(again, "digest", "left_semi").select("id").distinct(), "again")
    rows = ids.count()
    copies = docs.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, "id", "left_semi")
    folded = copies.select("id", "text").mapInArrow(_canonical_rows, "id long, digest string, folded string")
    ends = folded.groupBy("digest").agg(F.min("folded").alias("lo"), F.max("folded").alias("hi"))
    clashing = materialize(ends.where("lo <> hi").select("digest"), "clashes")
    texts = folded.join(F.broadcast(clashing) if clashing.count() <= BROADCAST_ROWS else clashing, "digest").select("digest", "folded").distinct()
    return texts.withColumn("suffix", F.row_number().over(Window.partitionBy("digest").orderBy("folded")) - 1)


def exact_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, fingerprint, class_id) with the smallest id of equal canonical texts.

    Null text reads as empty; empty and blank texts are equal to each other.  Repeated rows
    keep their rows.  A null id keeps its row and never names a class unless it stands alone.
    Other columns are ignored; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = materialize(digests(narrow, "id"), "digests")
    marked = with_suffix(narrow, found)
    classes = marked.groupBy("fingerprint").agg(F.min("id").alias("class_id"))
    return marked.join(classes, "fingerprint").select(F.col("id").alias(id_col), "n_chars", "fingerprint", "class_id")


def with_suffix(narrow: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``fingerprint``: its digest, and a suffix where bytes differ."""
    clashes = materialize(collisions(narrow, found), "suffixes")
    if not clashes.limit(1).count():
        return found.withColumn("fingerprint", F.col("digest"))
    held = narrow.join(found.join(clashes.select("digest").distinct(), "digest", "left_semi").select("id").distinct(), "id", "left_semi")
    folded = held.mapInArrow(_canonical_rows, "id long, digest string, folded string").join(clashes, ["digest", "folded"])
    names = folded.groupBy("id", "digest").agg(F.min("suffix").alias("suffix"))
    mark = F.when(F.coalesce("suffix", F.lit(0)) > 0, F.concat_ws("-", "digest", F.col("suffix").cast("string"))).otherwise(F.col("digest"))
    return found.join(names, ["id", "digest"], "left").withColumn("fingerprint", mark).drop("suffix")


def with_next_document(docs: DataFrame, parts: int) -> DataFrame:
    """(part, last, id, text) sorted so that each row's next document follows it.

    Documents are dealt to ranges of descending ids; the first document of each range is
    also the last row of the range before it (of the lowest range: the first of all), marked
    ``last``.  Texts move once; the copies are a row for each range.
    """
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    cuts = range_cuts(docs, "id", parts)
    keyed = keyed.withColumn("part", range_bucket(F.col("id"), cuts))
    tops = {r["part"]: r["id"] for r in keyed.groupBy("part").agg(F.max("id").alias("id")).collect()}  # a row for each range
    order = sorted(tops)
    goes = docs.sparkSession.createDataFrame([(tops[p], order[(i + 1) % len(order)]) for i, p in enumerate(order)], "head long, goes int")
    heads = keyed.join(F.broadcast(goes), F.col("id").eqNullSafe(F.col("head")))
    heads = heads.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("tie"))).where("rn = 1")
    heads = heads.select("id", "text", "tie", F.col("goes").alias("part"), F.lit(1).alias("last"))
    both = keyed.withColumn("last", F.lit(0)).unionByName(heads)
    spread = both.repartition(parts, "part").sortWithinPartitions("part", "last", F.col("id").desc_nulls_last(), "tie")
    return spread.select("part", "last", "id", "text")


def _edited(batches):
    held = None
    for batch in batches:
        rows = []
        for part, last, ident, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text = text or ""
            folded = canonical(text)
            mark = digest(folded)
            if held is not None and held[0] == part:
                rows.append(_edit(held, text, folded, mark))
            held = None if last else (part, ident, text, folded, mark)
        names = ["id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _edit(held, text, folded, mark):
    _, ident, own, own_folded, own_mark = held
    cut = len(own) // 3
    changed = own[: len(own) - cut] + text[:cut]
    changed_folded = canonical(changed)
    changed_mark = digest(changed_folded)
    alike = lambda a, b, x, y: float(a == b and x == y)
    return ident, len(own), hashlib.sha256(changed.encode()).hexdigest(), own_mark, changed_mark, alike(own_mark, changed_mark, own_folded, changed_folded), alike(own_mark, mark, own_folded, folded)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness (1 or 0).

    The edited text ends in the first code points of the next document by descending id
    instead of its own last third.  Exact digests are alike or not, so a likeness is 1 where
    the canonical texts are the same bytes and 0 elsewhere.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = with_next_document(narrow, shuffle_parts(docs.sparkSession))
    found = materialize(rows.mapInArrow(_edited, "id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double"), "edited")
    marked = with_suffix(narrow, found)
    return marked.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
