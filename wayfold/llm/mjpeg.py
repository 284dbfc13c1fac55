"""AVI motion-JPEG media columns: store bytes as intra frames, read them back, find shots.

Storing.  A payload is written into the quantised coefficients of baseline JPEG frames of
64 x 64 grey samples: 48 AC coefficients of each 8 x 8 block carry 48 bytes.  A coefficient of
size category 8 has 256 values, and the 8 bits that follow its Huffman code are the byte.
Quantisation is by 1 and the coefficients are the format's own unit, so nothing is lost.  The
frames lie in a RIFF AVI file with headers, a ``movi`` list and an ``idx1`` index; the payload
length stands in the stream's ``strd`` chunk.

Reading.  The RIFF chunks and the index are parsed, each frame's entropy-coded segment is
decoded (whole frames at once where all codes have the fixed form above, else bit by bit with
the frame's own Huffman tables), and the inverse transform gives the samples.

Shots.  Frames' histograms are compared with the frame before; a cut is where the difference
exceeds the mean of the differences around it by a multiple of their spread.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SIDE, PER_BLOCK, UNIT = 64, 48, 192
BLOCKS = (SIDE // 8) ** 2
PER_FRAME = BLOCKS * PER_BLOCK
MS_PER_FRAME = 40
FRAMES_AT_ONCE = 32
BINS, WINDOW, SPREAD, LEAST = 16, 8, 3.0, 0.15


def _zigzag() -> np.ndarray:
    """Places (row * 8 + column) of coefficients along the anti-diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_ANGLE = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16)
_BASIS = (_ANGLE * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)  # row: frequency


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, counts: list[int], symbols: list[int]) -> bytes:
    return bytes([kind, *counts, *[0] * (16 - len(counts)), *symbols])


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0] + [1] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, _table(0x00, [1], [0]) + _table(0x10, [1, 1], [8, 0]))  # DC: 0 is '0'; AC: 8 is '0', end of block '10'
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
_TAIL = b"\xff\xd9"
_FULL = 1 + 9 * PER_BLOCK + 2  # bits of a block with bytes; one without has 3


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that carry ``payload`` (a multiple of 48 bytes)."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, PER_BLOCK)
    frames = []
    for lo in range(0, len(data), BLOCKS * FRAMES_AT_ONCE):  # a byte for each bit, of a few frames at a time
        some = data[lo : lo + BLOCKS * FRAMES_AT_ONCE]
        bits = np.zeros((len(some), _FULL), np.uint8)
        bits[:, 1:-2].reshape(len(some), PER_BLOCK, 9)[:, :, 1:] = np.unpackbits(some, axis=1).reshape(len(some), PER_BLOCK, 8)
        bits[:, -2] = 1
        for at in range(0, len(some), BLOCKS):
            own = bits[at : at + BLOCKS].ravel()
            if len(some) - at < BLOCKS:
                own = np.concatenate([own, np.tile(np.array([0, 1, 0], np.uint8), BLOCKS - (len(some) - at))])
            if len(own) % 8:
                own = np.concatenate([own, np.ones(-len(own) % 8, np.uint8)])
            frames.append(_HEAD + np.packbits(own).tobytes().replace(b"\xff", b"\xff\x00") + _TAIL)
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that carry ``payload``."""
    frames = encode_frames(payload)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", MS_PER_FRAME * 1000, largest * 1000 // MS_PER_FRAME, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, MS_PER_FRAME, 1000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Avi:
    """What reading an AVI file gives."""

    frames: list[memoryview] = field(default_factory=list)
    ms_per_frame: float = MS_PER_FRAME
    payload_bytes: int | None = None


def read_avi(data: bytes) -> Avi:
    """Frames by the index (``movi`` chunks in order where there is none), and the headers."""
    view, out = memoryview(data), Avi()
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, listed = 0, b"", []

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, min(body + size, end))
            elif name == b"avih":
                out.ms_per_frame = struct.unpack_from("<I", data, body)[0] / 1000
            elif name == b"strd":
                out.payload_bytes = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = data[body : body + size]
            elif name[2:] in (b"dc", b"db"):
                listed.append(view[body : body + size])
            at = body + size + size % 2

    walk(12, len(data))
    if index:
        places = [(o, n) for name, _, o, n in struct.iter_unpack("<4sIII", index) if name[2:] in (b"dc", b"db")]
        base = movi if places and data[movi + places[0][0] : movi + places[0][0] + 4] == b"00dc" else 0  # offsets may count from the file's start
        out.frames = [view[base + o + 8 : base + o + 8 + n] for o, n in places]
    else:
        out.frames = listed
    return out


@dataclass
class Scan:
    """A frame's tables and entropy-coded bytes."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, dict[tuple[int, int], int]] = field(default_factory=dict)
    raw: bytes = b""


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, k, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse_jpeg(frame: bytes) -> Scan:
    """Segments of a baseline grey JPEG up to its entropy-coded data, without stuffing."""
    at, scan = 2, Scan()
    while at < len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                step = 2 if body[0] >> 4 else 1
                scan.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if step == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * step :]
        elif marker == 0xC0:
            _, scan.height, scan.width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("one component is read here")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("baseline frames are read here")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                scan.tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDA:
            scan.raw = frame[at : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
            break
    return scan


_FIXED = {0x00: {(1, 0): 0}, 0x10: {(1, 0): 8, (2, 2): 0}}


def coefficients(scan: Scan, full: int | None = None) -> np.ndarray:
    """Quantised coefficients (blocks, 64) in zigzag order.

    ``full``: how many blocks lead with 48 coefficients of category 8, if that is known;
    those are then read at once and checked.
    """
    blocks = -(-scan.width // 8) * -(-scan.height // 8)
    out = np.zeros((blocks, 64), np.int32)
    bits = np.unpackbits(np.frombuffer(scan.raw, np.uint8))
    if full is not None and scan.tables == _FIXED and len(bits) >= full * _FULL:
        own = bits[: full * _FULL].reshape(full, _FULL)
        coded = own[:, 1:-2].reshape(full, PER_BLOCK, 9)
        if not own[:, 0].any() and not coded[:, :, 0].any() and own[:, -2].all() and not own[:, -1].any():
            values = np.packbits(coded[:, :, 1:], axis=2)[:, :, 0].astype(np.int32)
            out[:full, 1 : 1 + PER_BLOCK] = np.where(values < 128, values - 255, values)
            return out
    stream, at, before = bits.tolist(), 0, 0

    def symbol(table: dict[tuple[int, int], int]) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            code = code << 1 | stream[at]
            at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def extra(size: int) -> int:
        nonlocal at
        value = 0
        for _ in range(size):
            value = value << 1 | stream[at]
            at += 1
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    for block in out:
        before += extra(symbol(scan.tables[0x00]))
        block[0] = before
        k = 1
        while k < 64:
            s = symbol(scan.tables[0x10])
            if s == 0:
                break
            k += s >> 4
            if s != 0xF0:
                block[k] = extra(s & 15)
            k += 1
    return out


def samples(scan: Scan, found: np.ndarray) -> np.ndarray:
    """The frame's samples (0 to 255), block by block: inverse transform, level shift, clamp."""
    flat = np.zeros((len(found), 64), np.float32)
    flat[:, ZIGZAG] = found * scan.quant[0] if (scan.quant[0] != 1).any() else found
    rows = (flat.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8)
    both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.rint(both + 128), 0, 255).astype(np.uint8)


def read_payload(data: bytes) -> tuple[bytes, np.ndarray]:
    """The stored payload and each frame's histogram (frames, BINS), shares of its samples."""
    avi = read_avi(data)
    left = avi.payload_bytes or 0
    parts, shapes = [], []
    for frame in avi.frames:
        scan = parse_jpeg(bytes(frame))
        full = min(left // PER_BLOCK, BLOCKS)
        found = coefficients(scan, full)
        own = found[:full, 1 : 1 + PER_BLOCK]
        parts.append(np.where(own < 0, own + 255, own).astype(np.uint8).tobytes())
        left -= full * PER_BLOCK
        shapes.append(np.bincount(samples(scan, found).ravel() >> 4, minlength=BINS))
    return b"".join(parts), np.array(shapes).reshape(-1, BINS) / (SIDE * SIDE)


def shots(shapes: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges [start, end) between cuts, by adaptive histogram differences.

    A cut stands before frame i where half the absolute difference to the frame before is at
    least ``LEAST`` and exceeds the mean of the up to ``2 * WINDOW`` differences around it
    (itself aside) by ``SPREAD`` of their standard deviations.
    """
    if not len(shapes):
        return []
    step = np.abs(np.diff(shapes, axis=0)).sum(axis=1) / 2
    cuts = []
    for i, d in enumerate(step.tolist()):
        around = np.concatenate([step[max(0, i - WINDOW) : i], step[i + 1 : i + 1 + WINDOW]])
        if d >= LEAST and (not len(around) or d > around.mean() + SPREAD * around.std()):
            cuts.append(i + 1)
    edges = [0, *cuts, len(shapes)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and these with bytes 32 up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def _store(batches):
    for batch in batches:
        offsets, _ = utf8(batch.column(1))
        for lo, hi in slices(offsets):
            both = [padded(t) for t in batch.column(1)[lo:hi].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([n for n, _ in both], pa.int64()), pa.array([write_avi(p) for _, p in both], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an AVI motion-JPEG column.

    Null text reads as empty and is stored as 192 spaces; equal texts give equal media;
    repeated rows and null ids keep their rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for ident, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = stored.as_py()  # one file at a time
            payload, shapes = read_payload(media)
            cuts = shots(shapes)
            mean = ",".join(str(int(x)) for x in np.rint(shapes.mean(axis=0) * 1000)) if len(shapes) else ""
            feature = f"frames={len(shapes)};shots={len(cuts)};starts={','.join(str(a) for a, _ in cuts)};tone={mean}"
            rows.append((ident, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_back(stored: DataFrame) -> DataFrame:
    """Payload digests and shot features of (doc_id, n_bytes, media), from the stored bytes."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _clips(batches):
    for batch in batches:
        rows = []
        for ident, media in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            step = read_avi(media).ms_per_frame
            rows += [(ident, k, a, b, int(a * step), int(b * step)) for k, (a, b) in enumerate(shots(read_payload(media)[1]))]
        names = ["doc_id", "clip", "first_frame", "end_frame", "start_ms", "end_ms"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows of a media column, one for each shot."""
    return stored.select("doc_id", "media").mapInArrow(_clips, "doc_id long, clip long, first_frame long, end_frame long, start_ms long, end_ms long")
