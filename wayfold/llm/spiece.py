"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch of texts is indexed as the concatenation of its distinct words (a word that occurs
again has the same ids): their suffix array is built by prefix doubling until the longest
piece is covered.  Every piece is looked up in it by binary search, all pieces at once; the
ranges found are the edges of a lattice: which piece covers which characters.  The edges are
sorted by position and relaxed from left to right.  For byte-pair encoding each prefix of a
word has exactly one last piece: the one that the merge order would not have joined otherwise
with the last piece of what precedes it.  That test (:meth:`Pieces.holds`) only walks down the
two pieces' own merges, so relaxing needs no priority queue and runs on whole arrays; words
that are very long are relaxed window by window.

Words are independent because no piece but runs of spaces has a space behind its first
character, and characters outside the vocabulary, line ends among them, become bytes.  Nothing
is kept from batch to batch, so memory is bounded by the batch.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SPACE = "▁"
LONGEST = 16
BATCH_BYTES = 8 << 20  # text whose distinct words are encoded together
INDEX_CHARS = 1 << 19  # characters of one suffix array
LONG_WORD = 400  # characters; longer words are relaxed by themselves
_ROUGH = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary, merges and the lattice of one model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in every]
        self.bytes = {int(self.text[i][3:5], 16): i for i in every if sp.is_byte(i)}
        special = {i for i in every if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = {self.text[i]: i for i in every if i not in special}
        self.score = [sp.get_score(i) for i in every]
        if max(map(len, self.ids)) > LONGEST or len(self.text) > 65_536:
            raise ValueError("pieces are at most 16 characters and ids 16 bits here")
        if any(SPACE in p[1:] and set(p) != {SPACE} for p in self.ids):
            raise ValueError("this encoder needs pieces without inner spaces")
        self.plain = [b"" if i in special else self.text[i].replace(SPACE, " ").encode() for i in every]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        self._rank()
        self._pack()

    # -- merges ---------------------------------------------------------------

    def merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Byte-pair encoding of a word by its definition (best score, then leftmost), and the last merge made."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (p := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.score[self.ids[p]], i, j, p))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(p):
                continue  # one of the two has been merged since
            last = (parts[i], parts[j])
            parts[i], parts[j], after[i] = p, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None], last

    def _rank(self) -> None:
        """Ranks in merge order, single characters first, and how each piece was merged."""
        made = {}
        for piece in self.ids:
            if len(piece) > 1 and set(piece) != {SPACE}:
                parts, last = self.merge(piece)
                if len(parts) == 1:
                    made[piece] = last
        single = [p for p in self.ids if len(p) == 1]
        order = single + sorted(made, key=lambda p: -self.score[self.ids[p]])
        rank = {p: k for k, p in enumerate(order)}
        self.order, self.singles = order, len(single)
        self.left = np.arange(len(order), dtype=np.int64)
        self.right = self.left.copy()
        pairs = {}
        for p, (a, b) in made.items():
            self.left[rank[p]], self.right[rank[p]] = rank[a], rank[b]
            pairs[rank[a] * 65_536 + rank[b]] = rank[p]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.slots = np.full(1 << 22, -1, np.int32)  # direct lookup by a hash, checked against the key
        h = self._slot(self.pair_keys)
        self.slots[h] = np.arange(len(h), dtype=np.int32)
        self.crowded = np.flatnonzero(self.slots[h] != np.arange(len(h)))
        self.crowd_keys = self.pair_keys[self.crowded]
        self.to_id = np.array([self.ids[p] for p in order], np.uint16)
        self.size_of = np.array([len(p) for p in order], np.int64)
        self.pairs, self.halves = pairs, (self.left.tolist(), self.right.tolist())

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two ranks merge into, or a number beyond all ranks."""
        keys = a * 65_536 + b
        at = self.slots[self._slot(keys)]
        out = np.where((at >= 0) & (self.pair_keys[at] == keys), self.pair_made[at], 1 << 40)
        if len(self.crowded):
            k = np.minimum(np.searchsorted(self.crowd_keys, keys), len(self.crowded) - 1)
            hit = self.crowd_keys[k] == keys
            out[hit] = self.pair_made[self.crowded[k[hit]]]
        return out

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces ``a`` and ``b`` stay apart when their texts are encoded together.

        The merges of both are undone from the latest on; had any pair across the border
        merged before the undone merges, the two would not both stand.
        """
        good = np.zeros(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 39)
        while len(live):
            ok = self.joined(a, b) >= limit
            live, a, b, limit = live[ok], a[ok], b[ok], limit[ok]
            later = a > b
            for _ in range(2):  # undo the later merge; a single character has none, then the other's
                todo = np.ones(len(a), bool) if _ == 0 else stuck
                one, two = todo & later, todo & ~later
                limit = np.where(one, a, np.where(two, b + 1, limit))
                na, nb = np.where(one, self.right[a], a), np.where(two, self.left[b], b)
                stuck = (one & (na == a)) | (two & (nb == b))
                a, b = na, nb
                later = np.where(stuck, ~later, later)
            good[live[stuck]] = True
            go = ~stuck
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return good

    def holds_one(self, a: int, b: int) -> bool:
        """:meth:`holds` of one pair."""
        (left, right), get, limit = self.halves, self.pairs.get, 1 << 39
        while get(a * 65_536 + b, 1 << 40) >= limit:
            if a > b:
                limit, part = a, right[a]
                if part == a:
                    return True
                a = part
            else:
                limit, part = b + 1, left[b]
                if part == b:
                    return True
                b = part
        return False

    # -- matching -------------------------------------------------------------

    def _pack(self) -> None:
        """Pieces as four integers of four characters each, for binary search."""
        chars = np.array(sorted({ord(c) for p in self.order for c in p}), np.uint32)
        self.code_of = np.zeros(0x110000, np.int32)  # 1 and up, 0 where the vocabulary has no such character
        self.code_of[chars] = np.arange(1, len(chars) + 1)
        self.bits = int(len(chars) + 1).bit_length()
        rank = {p: k for k, p in enumerate(self.order[: self.singles])}
        self.single_rank = np.array([rank[chr(c)] for c in chars], np.int64)
        longer = self.order[self.singles :]
        codes = np.zeros((len(longer), LONGEST), np.int64)
        size = np.array([len(p) for p in longer])
        for k, p in enumerate(longer):
            codes[k, : len(p)] = np.searchsorted(chars, np.frombuffer(p.encode("utf-32-le"), np.uint32)) + 1
        top = np.where(np.arange(LONGEST)[None, :] >= size[:, None], (1 << self.bits) - 1, codes)
        self.per_key = 62 // self.bits  # characters in an integer
        self.n_keys = -(-LONGEST // self.per_key)
        self.piece_lo, self.piece_hi, self.piece_size = self._keys(codes), self._keys(top), size

    def _keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """The characters of each row, ``per_key`` to an integer."""
        k = self.per_key
        wide = np.concatenate([codes, np.zeros((len(codes), k), np.int64)], axis=1)
        return [sum((wide[:, j * k + i] << (k - 1 - i) * self.bits for i in range(k)), np.zeros(len(codes), np.int64)) for j in range(self.n_keys)]

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array, as far as pieces reach, and each suffix's characters as integers.

        Prefix doubling: suffixes are ranked by their first ``per_key`` characters, then by the
        ranks at their start and as far on as these reach, until the longest piece is covered
        or all ranks differ.
        """
        n, k = len(codes), self.per_key
        reach = self.n_keys * k
        padded = np.concatenate([codes, np.zeros(reach + k, np.int64)])
        packed = np.zeros(n + reach, np.int64)
        for i in range(k):
            packed |= padded[i : i + n + reach] << (k - 1 - i) * self.bits
        order = np.argsort(packed)
        rank, by = self._ranks(packed, order), k
        while by < LONGEST and rank.max() < len(rank) - 1:
            later = np.zeros(len(rank), np.int64)
            later[:-by] = rank[by:]
            both = rank * len(rank) + later
            order = np.argsort(both)
            rank, by = self._ranks(both, order), 2 * by
        order = order[order < n]
        return order, [packed[order + j * k] for j in range(self.n_keys)]

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        own = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        return rank

    @staticmethod
    def _search(sorted_keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all of ``wanted`` at once in suffix order."""
        n = len(sorted_keys[0])
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n)
        while np.any(lo < hi):
            mid = np.minimum((lo + hi) // 2, n - 1)
            less = np.zeros(len(lo), bool)
            tied = np.ones(len(lo), bool)
            for keys, want in zip(sorted_keys, wanted, strict=True):
                got = keys[mid]
                less |= tied & (got < want)
                tied &= got == want
            if after:
                less |= tied
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, size) of all pieces in ``codes`` (0 separates), single characters included."""
        order, packed = self._suffixes(codes)
        lo, hi = self._search(packed, self.piece_lo, False), self._search(packed, self.piece_hi, True)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        shift = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        own = np.flatnonzero(codes)
        start = np.concatenate([order[np.arange(count.sum()) + shift], own])
        piece = np.concatenate([np.repeat(found + self.singles, count), self.single_rank[codes[own] - 1]])
        return start, piece, self.size_of[piece]

    def lattice(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of known characters, one after another, and how many each has."""
        ends = np.cumsum(lengths) + np.arange(1, len(lengths) + 1)  # one separator behind each word
        begins = ends - lengths - 1
        n = int(ends[-1])
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = codes
        start, piece, size = self._edges(text)
        # Sort the edges: by how far into its word an edge ends, word, longest first.
        word = np.repeat(np.arange(len(lengths)), lengths + 1)[start]
        at = start + size
        key = (at - begins[word]) << 40 | word << 6 | (LONGEST - size)
        sort = np.argsort(key)
        start, piece, at, depth, word = start[sort], piece[sort], at[sort], (key[sort] >> 40), word[sort]
        last = np.full(n + 1, -1, np.int64)
        first = np.concatenate([[True], (word[1:] != word[:-1]) | (depth[1:] != depth[:-1])])
        group = np.flatnonzero(first)
        group_end = np.append(group[1:], len(first))
        layer = np.searchsorted(depth[group], np.arange(1, int(depth[-1]) + 2))
        for p in range(len(layer) - 1):
            now, stop = group[layer[p] : layer[p + 1]].copy(), group_end[layer[p] : layer[p + 1]]
            while len(now):
                good = start[now] == begins[word[now]]
                rest = np.flatnonzero(~good)
                good[rest] = self.holds(last[start[now[rest]]], piece[now[rest]])
                last[at[now[good]]] = piece[now[good]]
                now, stop = now[~good] + 1, stop[~good]
                more = now < stop
                now, stop = now[more], stop[more]
        # Walk back from each word's end.
        where, who, taken, owner = ends - 1, np.arange(len(lengths)), [], []
        while len(where):
            piece = last[where]
            taken.append(piece)
            owner.append(who)
            where = where - self.size_of[piece]
            live = where > begins[who]
            where, who = where[live], who[live]
        turn = np.repeat(np.arange(len(taken))[::-1], [len(t) for t in taken])
        taken, owner = np.concatenate(taken), np.concatenate(owner)
        sort = np.argsort(owner << 32 | turn)
        return self.to_id[taken[sort]], np.bincount(owner, minlength=len(lengths))

    def long_word(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long word: its edges are found and relaxed a window at a time."""
        n = len(codes)
        last = np.zeros(n + 1, np.uint16)
        for lo in range(0, n, INDEX_CHARS):
            hi, back = min(n, lo + INDEX_CHARS), max(0, lo - LONGEST)
            start, piece, size = self._edges(np.append(codes[back:hi], 0).astype(np.int64))
            end = start + size
            sort = np.lexsort((-size, end))
            sort = sort[end[sort] > lo - back]
            done = 0
            for a, x, e in zip((start[sort] + back).tolist(), piece[sort].tolist(), (end[sort] + back).tolist(), strict=True):
                if e > done and (a == 0 or self.holds_one(int(last[a]), x)):
                    last[e], done = x, e
        out, at = [], n
        while at:
            out.append(last[at])
            at -= int(self.size_of[last[at]])
        return self.to_id[np.array(out[::-1], np.int64)]

    # -- texts ----------------------------------------------------------------

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids (16 bits each) of distinct words; characters outside the vocabulary split them."""
        out: list[bytes] = []
        full = [w if w[:1] in ("\n", SPACE) else SPACE + w for w in words]
        size = np.fromiter(map(len, full), np.int64, len(full))
        ends = np.cumsum(size)
        lo = 0
        while lo < len(full):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + INDEX_CHARS, "right")))
            out += self._some_ids(full[lo:hi], size[lo:hi])
            lo = hi
        return out

    def _some_ids(self, full: list[str], size: np.ndarray) -> list[bytes]:
        text = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code_of[text]
        # Units: stretches of known characters within a word, and single unknown characters.
        word_at = np.concatenate([[0], np.cumsum(size)])
        known = codes > 0
        new = np.ones(len(text), bool)
        new[1:] = ~(known[1:] & known[:-1])
        new[word_at[:-1]] = True
        unit = np.flatnonzero(new)
        unit_size = np.diff(np.append(unit, len(text)))
        is_known = known[unit]
        spaces = is_known & (unit_size > 1) & (text[unit] == ord(SPACE)) & (text[np.minimum(unit + 1, len(text) - 1)] == ord(SPACE))
        long = is_known & ~spaces & (unit_size > LONG_WORD)
        short = is_known & ~spaces & ~long
        count = np.zeros(len(unit), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []  # units and their ids, one after another
        if short.any():
            inside = np.repeat(short, unit_size)
            flat, count[short] = self.lattice(codes[inside], unit_size[short])
            made.append((np.flatnonzero(short), flat))
        for i in np.flatnonzero(long).tolist():
            flat = self.long_word(codes[unit[i] : unit[i] + unit_size[i]])
            count[i] = len(flat)
            made.append((np.array([i]), flat))
        for i in np.flatnonzero(spaces).tolist():  # runs of spaces tie in score: by the definition
            run = text[unit[i] : unit[i] + unit_size[i]].tobytes().decode("utf-32-le")
            flat = np.array([self.ids[x] for x in self.merge(run)[0]], np.uint16)
            count[i] = len(flat)
            made.append((np.array([i]), flat))
        others = np.flatnonzero(~is_known)
        for c in np.unique(text[unit[others]]).tolist():
            own = others[text[unit[others]] == c]
            flat = np.array([self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")], np.uint16)
            count[own] = len(flat)
            made.append((own, np.tile(flat, len(own))))
        at = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(at[-1], np.uint16)
        for units, flat in made:
            n = count[units]
            ids[np.arange(len(flat)) + np.repeat(at[units] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] = flat
        cut = (at[np.searchsorted(unit, word_at)] * 2).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text.  One that starts neither with a space nor a line end follows a space."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text or "\r" in text:
            found = _ROUGH.findall(SPACE + text.replace(" ", SPACE))
            return [w if w[0] in (SPACE, "\n") else "\n" + w for w in _after_line_ends(found)]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 16 bits each, little-endian."""
        split = [self.words(t) for t in texts]
        every = list(set().union(*split))
        get = dict(zip(every, self.word_ids(every), strict=True)).__getitem__
        return [b"".join(map(get, w)) for w in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; the space that encoding put in front goes away."""
        text = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _after_line_ends(found: list[str]) -> list[str]:
    """Join a run of line ends with the word behind it, so that each word says how it starts."""
    out, held = [], ""
    for w in found:
        if w[0] == "\n":
            out += ["\n"] * (len(w) - 1)
            held = "\n"
        elif w[0] == SPACE:
            if held:
                out.append(held)
            held = ""
            out.append(w)
        else:
            out.append(held + w)
            held = ""
    return [*out, held] if held else out


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def _encode(model_file: str, keep_ids: bool):
    def run(batches):
        model = pieces(model_file)
        for batch in batches:
            offsets, _ = utf8(batch.column(1))
            for lo, hi in slices(offsets, BATCH_BYTES):
                texts = [t or "" for t in batch.column(1)[lo:hi].to_pylist()]
                ids = model.encode(texts)
                count, crc, back, same = [], [], [], []
                for text, own in zip(texts, ids, strict=True):
                    wide = np.frombuffer(own, np.uint16)
                    plain = model.decode(wide)
                    count.append(len(wide))
                    crc.append(zlib.crc32(wide.astype("<u4").tobytes()))
                    back.append(sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(plain == text.replace(SPACE, " "))
                columns = [batch.column(0)[lo:hi], pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(back), pa.array(same)]
                names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
                if keep_ids:
                    flat = np.frombuffer(b"".join(ids), np.uint16).astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_decode(docs: DataFrame, model_file: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip[, ids]) of every whole text.

    The ids are those of the model's own library, without begin and end marks.  Decoding
    gives the text back (the space mark itself reads as a space); ``round_trip`` says so.
    Null and empty texts have no ids.  Repeated rows and null ids keep their rows; other
    columns are ignored.
    """
    columns = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_encode(model_file or default_model(), keep_ids), columns)
