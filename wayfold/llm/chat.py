r"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts: prompt and response, instruction with
input and output, message lists.  The set of its nested field paths (array elements share a
path) is hashed; the hash selects a declarative mapping, which names for every canonical turn
the path it comes from.  Turns are then written through one template::

    <|turn|>role\ntext<|end|>\n

Texts never end a turn or imitate one: a backslash is doubled, and ``\;`` is put after the
first character of every control string, so that no control string survives inside a text.
Both steps are undone by :func:`parse`.  The spans of assistant texts are the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, utf8

PART_BYTES = 1 << 20  # text of one record of a long conversation
TURN, END = "<|turn|>", "<|end|>"
# Control strings of common chat formats, all escaped inside texts (fixed values).
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", ";": "", "n": "\n"}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\;", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _PLAIN[m[1]], text)


@dataclass(frozen=True)
class Listed:
    """Turns of a list field: where it is, its role and text fields, names of roles."""

    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths it needs and may have, and its turns as (role, field) or a list."""

    needs: tuple[str, ...]
    turns: tuple[tuple[str, str] | Listed, ...]
    may: tuple[str, ...] = ()


def _listed(field: str, role: str, text: str, *roles: tuple[str, str]) -> Mapping:
    """A list of turns behind an optional system text; an empty list has no paths of its own."""
    return Mapping((field,), (("system", "system"), Listed(field, role, text, roles)), ("system", f"{field}[].{role}", f"{field}[].{text}"))


MAPPINGS = (
    Mapping(("prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response")), ("system",)),
    Mapping(("prompt", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Mapping(("instruction", "output"), (("system", "system"), ("user", "instruction"), ("assistant", "output")), ("system",)),
    Mapping(("instruction", "input", "output"), (("system", "system"), ("system", "instruction"), ("user", "input"), ("assistant", "output")), ("system",)),
    _listed("messages", "role", "content"),
    _listed("conversations", "from", "value", ("human", "user"), ("gpt", "assistant")),
)


def field_paths(value: object) -> Iterator[str]:
    """Paths of all fields of a JSON value; elements of an array share theirs."""
    todo = [("", value)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            for name, inner in value.items():
                path = f"{at}.{name}" if at else name
                yield path
                todo.append((path, inner))
        elif isinstance(value, list):
            todo += [(at + "[]", inner) for inner in value]


def fingerprint(paths: Iterable[str]) -> int:
    """Signed 64-bit hash of a set of field paths."""
    return xxhash.xxh3_64_intdigest("\n".join(sorted(set(paths)))) - (1 << 63)


# Paths that some mapping reads; all others (ids, names, dates) do not take part in the choice.
_READ = {p for m in MAPPINGS for p in m.needs + m.may}
_BY_FINGERPRINT = {fingerprint((*m.needs, *some)): m for m in MAPPINGS for n in range(len(m.may) + 1) for some in combinations(m.may, n)}


def canonical_turns(record: object) -> tuple[int, list[tuple[str, str]] | None]:
    """The fingerprint and the turns of a record; None where no mapping knows its layout.

    The fingerprint is that of the paths that mappings read, or of all paths if none knows it.
    """
    paths = set(field_paths(record))
    mark = fingerprint(paths & _READ)
    mapping = _BY_FINGERPRINT.get(mark)
    if mapping is None or not isinstance(record, dict):
        return fingerprint(paths), None
    turns = []
    for item in mapping.turns:
        if isinstance(item, Listed):
            names, rows = dict(item.roles), record[item.field]
            if rows is not None and not (isinstance(rows, list) and all(isinstance(x, dict) for x in rows)):
                return fingerprint(paths), None
            for x in rows or []:
                role = _text(x.get(item.role))
                turns.append((names.get(role, role), _text(x.get(item.text))))
        elif item[1] in record:
            turns.append((item[0], _text(record[item[1]])))
    return mark, turns


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def write(turns: Iterable[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (start, end) of the texts of role ``learned``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
        body = escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role), unescape(rest.rpartition(END)[0])))
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows that hold about a megabyte in a column."""
    offsets, _ = utf8(batch.column(column))
    for lo, hi in slices(offsets):
        yield batch.slice(lo, hi - lo)


def _format(batches):
    for whole in batches:
        for batch in _by_bytes(whole, 2):
            out: list[tuple] = []
            for record in batch.column(2).to_pylist():
                try:
                    mark, turns = canonical_turns(json.loads(record or "null"))
                except (ValueError, RecursionError):
                    mark, turns = None, None
                text, spans = write(turns) if turns is not None else (None, None)
                out.append((mark, text, spans and [{"start": a, "end": b} for a, b in spans] if spans is not None else None))
            kinds = [pa.int64(), pa.string(), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "part", "fingerprint", "formatted", "loss_spans"])


def format_chats(records: DataFrame, id_col: str, json_col: str, part_col: str | None = None) -> DataFrame:
    """(id_col[, part_col], fingerprint, formatted, loss_spans) of JSON records, a row per record.

    A layout is chosen by the fields that mappings read; other fields are ignored, optional
    ones may be absent.  A record that is null, no JSON object, nested too deeply to be read
    or of an unknown layout gets null texts and spans and keeps its row (the fingerprint, null
    if nothing could be read, tells its layout); null texts and roles read as empty; a record
    without turns gives the empty text.  Other columns are ignored.  ``part_col`` numbers the
    records of a long chat, whose texts follow on each other.
    """
    part = F.col(part_col).cast("long") if part_col else F.lit(0).cast("long")
    narrow = records.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(json_col).alias("record"))
    made = narrow.mapInArrow(_format, "id long, part long, fingerprint long, formatted string, loss_spans array<struct<start: long, end: long>>")
    return made.select(F.col("id").alias(id_col), *([F.col("part").alias(part_col)] if part_col else []), "fingerprint", "formatted", "loss_spans")


def records_of_turns(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, part, record): rows (conv_id, turn, role, text) as JSON, in the layout that fits.

    Turns are ordered by (turn, role, text), so ties and repeated rows have one order.  A part
    is a run of turns of about ``part_bytes``, so a conversation of any length is rows of
    bounded size; most conversations are one part.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("text") + F.octet_length("role") + 64
    laid = rows.withColumn("seq", F.count(F.lit(1)).over(order)).withColumn("part", F.floor((F.sum(size).over(order) - size) / part_bytes))
    conv = laid.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    said = lambda i: F.col("t")[i]["text"]
    renamed = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    listed = lambda xs, role, text: F.transform(xs, lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    two = F.forall("t", lambda x: x["role"].isin("user", "assistant"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))))
        .when((roles[0] == "system") & (F.size("t") > 1), F.to_json(F.struct(said(0).alias("system"), listed(F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), "role", "content").alias("messages"))))
        .when(two, F.to_json(F.struct(F.transform("t", lambda x: F.struct(renamed(x).alias("from"), x["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(listed(F.col("t"), "role", "content").alias("messages"))))
    )
    return conv.select("conv_id", "part", record.alias("record"))


class _Digest:
    """Counters and hashes of one conversation, fed part by part."""

    def __init__(self) -> None:
        self.turns = self.learned = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str | None, spans: list[dict] | None) -> None:
        if text is None or spans is None:  # a record without a known layout has no turns
            return
        turns = parse(text)
        self.turns += len(turns)
        self.chars += len(text)
        for role, said in turns:
            self.whole.update(f"{role}\n{said}\n".encode())
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.learned += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.turns, self.whole.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def _read_back(batches):
    """Rows come sorted by conversation and part; what is known of one is carried from batch to batch."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    now, digest = None, None
    for whole in batches:
        for batch in _by_bytes(whole, 1):
            out = []
            for ident, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest is None or ident != now:
                    if digest:
                        out.append((now, *digest.row()))
                    now, digest = ident, _Digest()
                digest.add(text, spans)
            yield made(out)
    if digest:
        yield made([(now, *digest.row())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the loss text of (conv_id, part, formatted, loss_spans).

    A conversation's parts are streamed in order through one hash, so none is ever held whole.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss_spans")
    return dealt.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escaped(column: str) -> str:
    counts = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS)
    return f"(length({column}) + length({column}) - length(replace({column}, '\\', '')) + 2 * ({counts}))"


ORACLE_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum({len(TURN) + len(END) + 2} + {_sql_escaped("role")} + {_sql_escaped("text")}) as bigint) as formatted_chars
from turns group by conv_id
"""
