"""Cutting long plans: a step's rows are written where all machines see them, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on one machine a temporary one where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="wayfold-steps-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """The rows of ``df`` as a table of their own, so that later plans start from it and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/steps/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_steps() -> None:
    """Delete the tables that :func:`settle` wrote; what still reads them ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            continue


atexit.register(forget_steps)
