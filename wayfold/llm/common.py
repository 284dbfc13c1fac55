"""Pieces shared by the training-data operators.

Everything here keeps to three rules: text is looked at whole, state shared between
machines goes through the folder named by ``spark.checkpoint.dir``, and nothing that grows
with the corpus reaches the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Documented bound of what is broadcast: rows of a few longs each.  Beyond it the operators
# use shuffled joins that give the same rows.
BROADCAST_ROWS = 1_000_000

WORD = r"[^\x20\x09-\x0D]+"
_WRITTEN: dict[str, SparkSession] = {}
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a temporary one where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    if (own := _SCRATCH.get()) is not None:
        own.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once nothing reads them any more."""
    for made in tables:
        _delete(made.written_to)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that :func:`materialize` wrote inside, but those passed to what it yields."""
    kept: list[str] = []
    outer = _SCRATCH.get()
    token = _SCRATCH.set([])

    def keep(made: DataFrame) -> DataFrame:
        kept.append(made.written_to)
        return made

    try:
        yield keep
    finally:
        own = _SCRATCH.get()
        _SCRATCH.reset(token)
        if outer is not None:
            outer.extend(kept)
        for path in own:
            if path not in kept:
                _delete(path)


def _delete(path: str) -> None:
    if spark := _WRITTEN.pop(path, None):
        with contextlib.suppress(Exception):  # the session may be gone at exit
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_written() -> None:
    """Delete the tables that :func:`materialize` wrote; results that still read them end."""
    for path in list(_WRITTEN):
        _delete(path)


atexit.register(forget_written)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted rows stay within the documented bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text makes a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (xor-shift, multiply), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """p**i and p**-i modulo 2**64 for odd p, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWERED = _BYTE_VALUE.copy()
_LOWERED[65:91] = _BYTE_VALUE[97:123]


def words_of(raw: np.ndarray, offsets: np.ndarray, fold_ascii: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and start and end of each word, of concatenated texts.

    ``offsets`` are the texts' borders within ``raw``; no word crosses one.  The hash of a
    word is a polynomial over random byte values modulo 2**64, taken from prefix sums and
    finalised with the word's length.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    inside = ~_SPACE[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    first[borders] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if fold_ascii else _BYTE_VALUE)[raw] * up[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends


def range_cuts(df: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """At most ``parts - 1`` ascending cut values that deal ``key`` into ranges of like counts.

    Only the key column is read.  The cuts are approximate; any cuts give right results.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, accuracy).alias("q")).first()["q"]
    return sorted({x for x in got or [] if x is not None})


def range_bucket(key, cuts: list) -> F.Column:
    """Index of the range of ``key``: how many cuts lie below it (null goes first)."""
    if not cuts:
        return F.lit(0)
    every = F.array(*[F.lit(c) for c in cuts])
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    if len(cuts) <= 64:
        return F.coalesce(below(every), F.lit(0))
    step = math.isqrt(len(cuts))  # two short searches instead of a long one
    block = below(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]))
    return F.coalesce(block * step + below(F.slice(every, block * step + 1, step)), F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
