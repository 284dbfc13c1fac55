"""WARC records, and resolution of not-modified revisits.

A crawler that gets "304 Not Modified" stores a revisit record without a body.  To read such a
page its record is joined, by canonical URL, with the latest earlier full response (an as-of
join), the validators (ETag, else Last-Modified) are compared, and the header fields that a
304 may update are merged into the stored ones.

The as-of join splits hot URLs by time: records fall into ranges of time, each range carries
its last full response to the next ones (an aggregate and a short window over the ranges), and
only within a range are records put in order.  Bodies take no part in it.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, range_bucket, range_cuts, shuffle_parts

# Header fields that a 304 response may update (RFC 9110 15.4.5, RFC 9111 3.2), lower case.
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
_SCHEME = re.compile(r"^[a-z][a-z0-9+.-]*://")


def canonical_url(url: str | None) -> str:
    """Lower case, without scheme, leading ``www.``, fragment, default port, ``utm_`` parameters
    and trailing slashes, with parameters sorted; null reads as empty."""
    text = (url or "").strip().lower().partition("#")[0]
    text = _SCHEME.sub("", text)
    host, slash, rest = text.partition("/")
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", host))
    path, _, query = rest.partition("?")
    kept = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
    path = (slash + path).rstrip("/")
    return host + path + ("?" + "&".join(kept) if kept else "")


def write_record(kind: str, uri: str, date: str, record_id: str, status: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One WARC/1.1 record with an HTTP response in it."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body
    lines = [("WARC-Type", kind), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Record-ID", f"<{record_id}>"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http)))]
    if kind == "revisit":
        lines.insert(1, ("WARC-Profile", REVISIT))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + http + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(raw: bytes) -> dict | None:
    """The fields of a record; None if it is none or holds no HTTP response."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    warc = _fields(head.partition(b"\r\n")[2])
    size = warc.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    http, _, body = block.partition(b"\r\n\r\n")
    first, _, lines = http.partition(b"\r\n")
    status = first.split(b" ")[1] if first.startswith(b"HTTP/") and b" " in first else b""
    try:
        when = datetime.fromisoformat(warc.get("warc-date", "").replace("Z", "+00:00"))
        when = int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1_000_000)
    except ValueError:
        when = None
    return {"kind": warc.get("warc-type"), "url": warc.get("warc-target-uri"), "time": when, "record_id": warc.get("warc-record-id", "").strip("<>"), "status": int(status) if status.isdigit() else None, "headers": _fields(lines), "body": body}


_PARSED = "record_id string, kind string, url string, canon string, time long, status int, etag string, modified string, headers map<string,string>, body_bytes long, body_sha256 string"


def _parse(batches):
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for raw in batch.column(0):
            got = parse_record(raw.as_py()) if raw.is_valid else None
            if got:
                h = got["headers"]
                rows.append((got["record_id"], got["kind"], got["url"], canonical_url(got["url"]), got["time"], got["status"], h.get("etag"), h.get("last-modified"), list(h.items()), len(got["body"]), hashlib.sha256(got["body"]).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def parse_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """Parsed fields of raw records, without bodies (their size and sha256 instead).

    Null rows and rows that are no WARC records are left out.
    """
    return raw.select(F.col(column)).mapInArrow(_parse, _PARSED)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The columns of :func:`parse_records` and what each record resolves to.

    A response with status 200 stands for itself (``full``).  A revisit takes the latest
    response of the same canonical URL before it: ``resolved`` if a validator that both have
    is the same (ETag first, then Last-Modified), ``mismatch`` if it differs or both lack
    one, ``missing`` if there is no such response; only ``resolved`` ones get
    ``source_id``, ``payload_sha256`` and ``payload_bytes``.  Other records are ``other``.
    ``merged`` are a resolved revisit's source's fields with the permitted ones of the
    revisit put in.  Ties in time are ordered by record id; a null time precedes all; equal
    records each keep a row.  An empty table gives an empty result.
    """
    records = materialize(records, "records")
    full = (F.col("kind") == "response") & F.coalesce(F.col("status") == 200, F.lit(False))
    cuts = range_cuts(records, "time", shuffle_parts(records.sparkSession))
    narrow = records.withColumn("span", range_bucket(F.col("time"), cuts)).withColumn("full", F.coalesce(full, F.lit(False)))
    when = F.struct(F.coalesce("time", F.lit(-(1 << 62))).alias("time"), F.col("record_id").alias("record_id"))
    source = F.struct(when.alias("when"), "record_id", "etag", "modified", "headers", "body_bytes", "body_sha256")
    lasts = narrow.where("full").groupBy("canon", "span").agg(F.max_by(source, when).alias("last"))
    # Each range's last response, handed on: rows are ranges of a URL, not records.
    spans = narrow.select("canon", "span").distinct().join(lasts, ["canon", "span"], "left")
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("canon").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("canon", "span", carried.alias("carried"))
    order = Window.partitionBy("canon", "span").orderBy(F.coalesce("time", F.lit(-(1 << 62))), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = narrow.withColumn("near", F.last(F.when(F.col("full"), source), ignorenulls=True).over(order))
    joined = near.join(spans, ["canon", "span"]).withColumn("src", F.coalesce("near", "carried"))
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    same = F.when(F.col("etag").isNotNull() & F.col("src.etag").isNotNull(), F.col("etag") == F.col("src.etag"))
    same = F.coalesce(same, F.when(F.col("modified").isNotNull() & F.col("src.modified").isNotNull(), F.col("modified") == F.col("src.modified")), F.lit(False))
    outcome = F.when(F.col("full"), "full").when(~revisit, "other").when(F.col("src").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    joined = joined.withColumn("outcome", outcome)
    resolved, own = F.col("outcome") == "resolved", F.col("outcome") == "full"
    updates = F.map_filter("headers", lambda k, v: k.isin(*MERGED))
    kept = F.map_filter("src.headers", lambda k, v: ~F.map_contains_key(updates, k))
    return joined.select(
        "record_id", "kind", "url", "canon", "time", "status", "outcome",
        F.when(resolved, F.col("src.record_id")).when(own, F.col("record_id")).alias("source_id"),
        F.when(resolved, F.col("src.body_sha256")).when(own, F.col("body_sha256")).alias("payload_sha256"),
        F.when(resolved, F.col("src.body_bytes")).when(own, F.col("body_bytes")).alias("payload_bytes"),
        F.when(resolved, F.map_concat(kept, updates)).otherwise(F.col("headers")).alias("merged"),
    )


def _crawl(batches):
    for batch in batches:
        out = []
        for page, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            body = (html or "").encode()
            tag = '"' + hashlib.md5(body).hexdigest() + '"'
            stamp = lambda t: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            first, again = FIRST_CRAWL + (page or 0), SECOND_CRAWL + (page or 0)
            out.append(write_record("response", url or "", stamp(first), f"urn:page:{page}:full", "200 OK", [("Content-Type", "text/html"), ("ETag", tag), ("Date", stamp(first)), ("Cache-Control", "max-age=60"), ("Content-Length", str(len(body)))], body))
            out.append(write_record("revisit", url or "", stamp(again), f"urn:page:{page}:again", "304 Not Modified", [("ETag", tag), ("Date", stamp(again)), ("Cache-Control", "max-age=600"), ("Content-Length", "0")], b""))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


FIRST_CRAWL, SECOND_CRAWL = 1_704_067_200, 1_735_689_600  # 2024-01-01 and 2025-01-01, UTC


def two_crawls(pages: DataFrame) -> DataFrame:
    """(record): all pages as a crawler stores them that comes twice and finds nothing changed."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_crawl, "record binary")


def pages_revisited(pages: DataFrame) -> DataFrame:
    """Each page's two records: outcome, source page, payload and merged fields."""
    found = resolve_revisits(parse_records(two_crawls(pages)))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("long")
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select(page("record_id").alias("page_id"), "kind", "canon", "outcome", page("source_id").alias("source_page"), "payload_sha256", F.col("payload_bytes"), lines.alias("merged"))


ORACLE_SQL = f"""
with cleaned as (
  select page_id, html, coalesce(html, '') as body,
    regexp_replace(split_part(lower(trim(coalesce(url, ''))), '#', 1), '^[a-z][a-z0-9+.-]*://', '') as u from pages),
parts as (
  select *, regexp_replace(regexp_replace(split_part(u, '/', 1), ':(80|443)$', ''), '^www\\.', '') as host,
    case when strpos(u, '/') > 0 then substr(u, strpos(u, '/')) else '' end as rest from cleaned),
named as (
  select *, host || rtrim(split_part(rest, '?', 1), '/') as place,
    list_sort(list_filter(string_split(case when strpos(rest, '?') > 0 then substr(rest, strpos(rest, '?') + 1) else '' end, '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as query from parts),
pages2 as (
  select page_id, body, place || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as canon,
    '"' || md5(body) || '"' as tag, sha256(body) as sha, octet_length(encode(body)) as size from named),
latest as (select canon, max(page_id) as page_id from pages2 group by canon),
joined as (
  select p.*, s.page_id as source_page, s.sha as source_sha, s.size as source_size, s.tag as source_tag
  from pages2 p join latest l on p.canon = l.canon join pages2 s on s.page_id = l.page_id)
select page_id, 'response' as kind, canon, 'full' as outcome, page_id as source_page, sha as payload_sha256, size as payload_bytes,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp(({FIRST_CRAWL} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'etag: ' || tag as merged
from joined
union all
select page_id, 'revisit', canon, case when tag = source_tag then 'resolved' else 'mismatch' end,
  case when tag = source_tag then source_page end, case when tag = source_tag then source_sha end, case when tag = source_tag then source_size end,
  'cache-control: max-age=600' || chr(10) || case when tag = source_tag then 'content-length: ' || source_size || chr(10) || 'content-type: text/html' else 'content-length: 0' end
    || chr(10) || 'date: ' || strftime(make_timestamp(({SECOND_CRAWL} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'etag: ' || tag
from joined
"""
