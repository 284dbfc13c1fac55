"""Population rasters as rows of cells.

A GeoTIFF is read by its strips or tiles: the driver reads the file's small directory, each
task the strips that it was dealt, so a raster of any size is never held whole.  Strips that
do not meet the wanted box are not read.  Coordinates must be degrees of WGS 84; a raster in
another system is refused instead of being read wrongly.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "row int, col int, density double, min_lon double, min_lat double, max_lon double, max_lat double"
# Tags of the TIFF and GeoTIFF formats, their number types and kinds of samples (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, PER_PIXEL, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE = 317, 322, 323, 324, 325, 339
SCALE, TIE, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
WGS84 = 4326


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


@dataclass(frozen=True)
class Tiff:
    """What a raster's directory says: sizes, blocks and the place of its cells."""

    order: str
    width: int
    height: int
    block_width: int
    block_height: int
    at: tuple[int, ...]
    size: tuple[int, ...]
    compression: int
    predictor: int
    kind: str
    west: float
    north: float
    step_x: float
    step_y: float
    no_data: float | None


def read_directory(file) -> Tiff:
    """The first image of a classic TIFF file."""
    head = _read(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    start = struct.unpack(order + "I", head[4:])[0]
    n = struct.unpack(order + "H", _read(file, start, 2))[0]
    raw = _read(file, start + 2, 12 * n)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
        if kind not in TYPES:
            continue
        own = f"{order}{count}{TYPES[kind]}"
        size = struct.calcsize(own)
        data = raw[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else _read(file, struct.unpack_from(order + "I", raw, 12 * i + 8)[0], size)
        tags[tag] = struct.unpack(own, data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if one(PER_PIXEL, 1) != 1:
        raise ValueError("one value a cell is expected")
    keys = tags.get(GEO_KEYS, ())
    system = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if system.get(3072) or system.get(2048, WGS84) != WGS84:  # projected, or other degrees
        raise ValueError("the raster must be in degrees of WGS 84")
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError("only plain and deflated rasters are read")
    tiled = TILE_AT in tags
    scale, tie = tags[SCALE], tags[TIE]
    empty = one(NO_DATA)
    kind = f"{order}{KINDS[one(SAMPLE, 1)]}{one(BITS, 8) // 8}"
    return Tiff(
        order, one(WIDTH), one(HEIGHT), one(TILE_WIDTH) if tiled else one(WIDTH), one(TILE_HEIGHT) if tiled else min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)),
        tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE], one(COMPRESSION, 1), one(PREDICTOR, 1), kind,
        tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], float(empty.rstrip(b"\0 ")) if empty else None,
    )


def decode_block(t: Tiff, raw: bytes) -> np.ndarray:
    """The cells of a strip or tile; a last strip may have fewer rows."""
    if t.compression != 1:
        raw = zlib.decompress(raw)
    rows = min(t.block_height, len(raw) // (t.block_width * np.dtype(t.kind).itemsize))
    if t.predictor == 3:  # bytes of a row by significance, each the difference to the one before
        wide = np.dtype(t.kind).itemsize
        lines = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * t.block_width * wide].reshape(rows, -1), axis=1, dtype=np.uint8)
        planes = lines.reshape(rows, wide, t.block_width).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{wide}").reshape(rows, t.block_width)
    cells = np.frombuffer(raw, t.kind)[: rows * t.block_width].reshape(rows, t.block_width)
    return np.cumsum(cells, axis=1, dtype=cells.dtype) if t.predictor == 2 else cells


def _blocks(path: str, t: Tiff, row0: int, row1: int, col0: int, col1: int):
    across = math.ceil(t.width / t.block_width)

    def run(batches):
        with _open(path) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    cells = decode_block(t, _read(file, t.at[k], t.size[k]))
                    top, left = k // across * t.block_height, k % across * t.block_width
                    rows, cols = np.nonzero(cells > 0)
                    value = cells[rows, cols].astype(np.float64)
                    rows, cols = rows + top, cols + left
                    keep = (rows >= row0) & (rows < row1) & (cols >= col0) & (cols < col1) & (value != t.no_data)
                    rows, cols, value = rows[keep], cols[keep], value[keep]
                    lon, lat = t.west + cols * t.step_x, t.north - rows * t.step_y
                    columns = [pa.array((rows - row0).astype(np.int32)), pa.array((cols - col0).astype(np.int32)), pa.array(value), pa.array(lon), pa.array(lat - t.step_y), pa.array(lon + t.step_x), pa.array(lat)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "col", "density", "min_lon", "min_lat", "max_lon", "max_lat"])

    return run


def read_population_raster(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells of positive density whose row and column meet the box, numbered from its north-west corner."""
    with _open(path) as file:
        t = read_directory(file)
    row0, row1 = max(0, math.floor((t.north - north) / t.step_y)), min(t.height, math.ceil((t.north - south) / t.step_y))
    col0, col1 = max(0, math.floor((west - t.west) / t.step_x)), min(t.width, math.ceil((east - t.west) / t.step_x))
    across = math.ceil(t.width / t.block_width)
    rows = range(row0 // t.block_height, max(row0 // t.block_height, math.ceil(row1 / t.block_height)))
    cols = range(col0 // t.block_width, max(col0 // t.block_width, math.ceil(col1 / t.block_width)))
    wanted = [(r * across + c,) for r in rows for c in cols if r * across + c < len(t.at)] if row0 < row1 and col0 < col1 else []
    blocks = spark.createDataFrame(wanted, "block long").repartition(max(1, min(len(wanted), spark.sparkContext.defaultParallelism)))
    return blocks.mapInArrow(_blocks(path, t, row0, row1, col0, col1), CELLS)


def graph_bounds(nodes: DataFrame) -> DataFrame:
    """One row (west, south, east, north): the box of all nodes."""
    return nodes.agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


def checked_degrees(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """The rows, or an error while they are read where a coordinate is no degree."""
    good = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    bad = F.raise_error(F.lit("coordinates must be degrees of WGS 84")).cast("boolean")
    return rows.where(F.coalesce(good, F.lit(True)) | bad)
