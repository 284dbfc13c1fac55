"""A training corpus from raw documents, stage by stage.

Each stage is (spark, docs, sf_dir) -> DataFrame.  :func:`run` applies them to ``documents``;
every stage's rows are written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, maybe_broadcast, scratch, table
from wayfold.llm.linedup import dedup_lines
from wayfold.llm.mixing import repeat_by_mix
from wayfold.llm.ngram_join import ngram_jaccard_components
from wayfold.llm.quality import keep_good
from wayfold.llm.spiece import encode_decode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more).

    It learns from all labelled documents that are not held out, and scores ``docs``; empty
    and null texts are scored like any other, and an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"), taught_by=table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more.

    A document that lost all its words with these lines goes; ``n_chars`` follows the text.
    Null and empty texts that lost nothing stay as they are.
    """
    # Rows travel as one column, so that their own columns may have any names.
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = dedup_lines(rows, longest=True)
    kept = kept.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("text"), "n_chars": chars}
    return kept.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies.

    Near copies share 80 % of their word 5-grams, or are linked through such.  Texts without
    words are in no group and stay, as do rows with a null id; of rows that repeat an id one
    stays, the first by a digest of the text.
    """
    with scratch() as keep:
        groups = ngram_jaccard_components(docs, n=5, num=80, den=100)
        gone = keep(materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone"))
    # Rows travel as one column, so that their own columns may have any names.
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(maybe_broadcast(gone, gone.count()), F.col("key") == F.col("id"), "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text")))
        kept = kept.withColumn("nth", first).where("nth = 1 or key is null")
    return kept.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 3 times) as the mix of sources by weights 1, 2, 3 takes them.

    A null source is a source of its own; texts without words (null ones too) go, as nothing
    of them can be taken; rows that repeat an id are taken alike; the columns stay, and an empty
    table stays empty.
    """
    return repeat_by_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's whole text and what decoding them gives.

    Columns: doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip, ids.  A null or empty
    text has no ids; every row keeps a row; other columns are ignored; an empty table stays empty.
    """
    return encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("sentencepiece", sentencepiece),
]

# Suffix sorting, similarity joins, a trained model and a subword vocabulary are beyond SQL;
# the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
