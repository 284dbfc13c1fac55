"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key (the id as nine bytes that sort like
the id, a null first).  Entries lie in blocks: a key is stored as the length of the prefix it
shares with the key before it and the rest of its bytes, its value are the ids.  Behind the
blocks stand a sparse index (first key, place and totals of each block), a Bloom filter over
the keys and a footer of fixed size.  A lookup reads the footer, asks the filter, searches the
index by bisection and reads one block.

Shards are written through the file system of the shared folder under names of their own and
listed in a manifest with their first and last key; only listed files are read, so a task that
runs again leaves no double, and a lookup opens only shards that can hold its key.  A writer
begins a new shard at a size in bytes or entries, so what it holds does not grow with the data.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, range_bucket, range_cuts, shared_dir, shuffle_parts, slices, utf8

MAGIC = b"WFSST\x01\x00\x00"
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")  # index place and size, filter place and size, documents, ids, bytes of an id
_ENTRY = struct.Struct("<BBI")  # shared prefix, rest of the key, bytes of the value
_INDEX = struct.Struct("<9sQIIQQ")  # first key, place, size, crc32, documents before, ids before
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20
CACHE_WORDS = 500_000
CACHE_LETTERS = 64  # longer words are not kept
JOINED_WORDS = 256


def key_of(ident: int | None) -> bytes:
    """Nine bytes that sort as ids do."""
    return bytes(9) if ident is None else b"\x01" + struct.pack(">Q", (ident + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> Iterator[int]:
    whole = xxhash.xxh3_128_intdigest(key)
    a, b = whole & ((1 << 64) - 1), whole >> 64 | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Writes one shard; entries come in ascending order of their keys."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.block, self.size, self.last, self.first = [], 0, b"", None
        self.before = (self.docs, self.ids)

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key]))
        if self.first is None:
            self.first = key
        self.block += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.size += _ENTRY.size + len(key) - shared + len(value)
        if not self.docs:
            self.lowest = key
        self.last = self.highest = key
        self.docs += 1
        self.ids += len(value) // self.width
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            raw = b"".join(self.block)
            self.out.write(raw)
            self.index.append(_INDEX.pack(self.first, self.at, len(raw), zlib.crc32(raw), *self.before))
            self.at += len(raw)
        self._start()

    def full(self) -> bool:
        return self.at >= SHARD_BYTES or self.docs >= SHARD_DOCS

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        marks = np.zeros(bits, np.uint8)
        for key in self.keys:
            marks[list(_probes(key, bits))] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(marks, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, MAGIC))


@dataclass
class Shard:
    """Reads one shard through a seekable file."""

    file: pa.NativeFile

    def __post_init__(self) -> None:
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw = self._read(index_at, index_size)
        self.index = list(_INDEX.iter_unpack(raw))
        self.firsts = [x[0] for x in self.index]
        raw = self._read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, crc, _, _ = self.index[k]
        raw = self._read(at, size)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        p, key = 0, b""
        while p < len(raw):
            shared, rest, n = _ENTRY.unpack_from(raw, p)
            p += _ENTRY.size
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, raw[p : p + n]
            p += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in _probes(key, self.bits))

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier (more than one if it repeats)."""
        key = key_of(ident)
        found: list[np.ndarray] = []
        if not self.index or not self.may_hold(key):
            return found
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.index) and self.firsts[k] <= key:
            found += [np.frombuffer(v, f"<u{self.width}") for own, v in self.block(k) if own == key]
            k += 1
        return found


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# -- encoding -----------------------------------------------------------------


_SIGNS = ".,;:!?)]}%&$#*"


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, a word at a time.

    The pattern that such a tokenizer splits texts by always has a border before a single
    space that follows and precedes other characters, and around a single line end.  Between
    these borders a text's ids do not depend on the rest of it, so the library encodes each
    distinct word once, thousands of them joined by spaces, and a cache of bounded size serves
    repeats.  Texts in which white
    space meets white space in ways that this does not cover are encoded as a whole, as are
    texts that hold an added token's string.
    """

    ODD = b"odd"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.line_end = self._bytes(self._ids("\n"))
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith("\u0120")
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of ``words`` into the cache; letters and the signs behind them go apart, as they do in the pattern."""
        cache, rest, alone, stems, bare = self.cache, [], [], set(), set()
        split, own_stem = [], []
        for w in words:
            if not w or w == "\n" or w[w[0] == "\n"].isspace():
                cache[w] = self.ODD
                continue
            line = w[0] == "\n"
            word = w[1:] if line else w
            stem = word.rstrip(_SIGNS)
            if stem.isalpha():
                split.append(w)
                own_stem.append(stem)
                if line:
                    bare.add(stem)
                elif stem not in cache:
                    stems.add(stem)
            elif line or w[-1].isspace():
                alone.append(w)
            else:
                rest.append(w)
        self._joined([*stems, *rest])
        texts = [*bare, *(w[1:] if w[0] == "\n" else " " + w for w in alone)]
        own = [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first = dict(zip(bare, own, strict=False))
        for w, ids in zip(alone, own[len(bare) :], strict=True):
            cache[w] = self.line_end + ids if w[0] == "\n" else ids
        for w, stem in zip(split, own_stem, strict=True):
            if w[0] == "\n":
                cache[w] = self.line_end + first[stem] + self._signs(w[len(stem) + 1 :])
            elif len(w) > len(stem):
                cache[w] = cache[stem] + self._signs(w[len(stem) :])

    def _joined(self, words: list[str]) -> None:
        """Words that neither begin a line nor end with white space: where a token begins with a space, so does a word."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cut = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            if len(cut) != len(g) + 1:
                raise ValueError("spaces do not separate words in this tokenizer")
            raw, cut = ids.tobytes(), (cut * self.width).tolist()
            self.cache.update((w, raw[a:b]) for w, a, b in zip(g, cut[:-1], cut[1:], strict=True))

    def _signs(self, tail: str) -> bytes:
        """Ids of a run of signs behind letters: one pretoken."""
        if len(self.tails) > 10_000:
            self.tails.clear()
        if tail not in self.tails:
            self.tails[tail] = self._bytes(self._ids(tail)) if tail else b""
        return self.tails[tail]

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and ``end``, little-endian, ``width`` bytes each."""
        whole = [any(a in t for a in self.added) for t in texts]
        split = [("\n" + t).replace("\n", " \n").split(" ")[1:] if t and not w else [] for t, w in zip(texts, whole, strict=True)]
        every = set().union(*split)
        if missing := every - self.cache.keys():
            self.learn(missing)
        get, stop, skip = self.cache.__getitem__, self._bytes([end]), len(self.line_end)
        out = []
        for text, words, alone in zip(texts, split, whole, strict=True):
            parts = list(map(get, words))
            if alone or self.ODD in parts:
                out.append(self._bytes(self._ids(text)) + stop)
            else:
                out.append(b"".join(parts)[skip:] + stop)  # without the line end put in front
        for w in missing:  # what this batch brought; long words are not kept
            if len(w) > CACHE_LETTERS:
                del self.cache[w]
        if len(self.cache) > CACHE_WORDS:  # keep the first half: frequent words come early
            self.cache = dict(islice(self.cache.items(), CACHE_WORDS // 2))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(path: str, end: int):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            offsets, _ = utf8(batch.column(2))
            for lo, hi in slices(offsets, 4 << 20):
                ids = coder.encode([t or "" for t in batch.column(2)[lo:hi].to_pylist()], end)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(ids, pa.binary())], ["part", "id", "ids"])

    return run


# -- writing and reading ------------------------------------------------------


_MANIFEST = "part int, seq int, name string, docs long, ids long, lowest binary, highest binary"


def _write(folder: str, width: int):
    def run(batches):
        fs, base = open_fs(folder)
        out, writer, now, name, seq = None, None, None, "", 0

        def finish():
            writer.close()
            out.close()
            row = (now, seq, name, writer.docs, writer.ids, writer.lowest, writer.highest)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "name", "docs", "ids", "lowest", "highest"])

        for batch in batches:
            for part, ident, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if writer and (part != now or writer.full()):
                    yield finish()
                    seq, writer = seq + 1, None
                if not writer:
                    now, name = part, f"{part:06d}-{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(f"{base}/{name}")
                    writer = Writer(out, width)
                writer.add(key_of(ident), ids.as_buffer().to_pybytes())
        if writer:
            yield finish()

    return run


def write_shards(docs: DataFrame, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encode ``docs`` and write them as shards of ascending id ranges.

    Returns the folder and its manifest (part, seq, name, docs, ids, lowest, highest), a row
    for each shard.  ``end`` is put behind each document, so null and empty texts have that id
    alone.  Repeated ids are neighbours, in the order of their ids' bytes; a null id comes
    first.  Other columns are ignored.  No rows: no shards.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    width = encoder(path).width
    parts = shuffle_parts(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = narrow.select(range_bucket(F.col("id"), range_cuts(narrow, "id", parts)).alias("part"), "id", "text")
    coded = keyed.mapInArrow(_encode(path, end), "part int, id long, ids binary")
    dealt = coded.repartition(parts, "part").sortWithinPartitions("part", "id", "ids")
    folder = f"{shared_dir(spark)}/wayfold/sst-{uuid.uuid4().hex}"
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    return folder, materialize(dealt.mapInArrow(_write(folder, width), _MANIFEST), "manifest")


def _read(folder: str):
    def run(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    shard = Shard(file)
                    for k in range(len(shard.index)):
                        rows = []
                        for key, value in shard.block(k):
                            wide = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                            rows.append((ident_of(key), start, len(wide), zlib.crc32(wide.tobytes())))
                            start += len(wide)
                        kinds = [pa.int64()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards' files.

    Where a shard's ids start is a running sum over the manifest, a row of it for each shard.
    """
    before = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "seq", "name", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    files = files.repartition(shuffle_parts(manifest.sparkSession), "part", "seq").select("name", "start")
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: DataFrame, ident: int | None) -> list[np.ndarray]:
    """The ids of one document, from the shards whose keys reach from below to above its own."""
    fs, base = open_fs(folder)
    key, found = key_of(ident), []
    for r in manifest.where((F.col("lowest") <= F.lit(key)) & (F.col("highest") >= F.lit(key))).orderBy("part", "seq").collect():
        with fs.open_input_file(f"{base}/{r['name']}") as file:
            found += Shard(file).get(ident)
    return found


def index_of_tokens(docs: DataFrame) -> DataFrame:
    """Write all documents as shards and return what reading the files gives."""
    folder, manifest = write_shards(docs)
    return read_shards(folder, manifest)


__all__ = ["Shard", "Writer", "index_of_tokens", "lookup", "read_shards", "write_shards"]
