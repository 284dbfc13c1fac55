"""Streams of events: windows, sessions and online trip counts, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_sessions(events: DataFrame, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, emitted when the watermark has passed them.

    In batch mode the same call gives the same sessions.
    """
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.select("user_id", "n", "first", "last")


def stream_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    c = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return c.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
