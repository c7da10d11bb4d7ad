"""WARC archives: pages to segmented records, and records back to pages.

Writing: a page becomes one ``response`` record whose HTTP message is sent in chunks
(transfer coding), or a ``revisit`` record if a page with the same payload holds the
response. A record longer than ``segment_bytes`` is split into a first segment and
``continuation`` records. Spark's text writer puts the records into files in any
store Spark writes to; records are never joined with, or moved for, one another. All
records of an archive have the date of its writing. The response that others revisit is
named by its page and payload, so that their ``WARC-Refers-To`` is its identifier; it is
left out where rows with that page_id and payload are repeated, as then only the target
and the date, which are always there, and our own field for the page tell it.

Reading: files are parsed once, record by record. A whole record is decoded where it is
found, and only its facts go on; segments are grouped by the identifier of their origin,
ordered by segment number, checked against the total length, and only then is the chunk
framing decoded. Of payloads, only those in segments are shuffled.

Null html is an empty payload. Equal page_ids are told apart by their order of
writing, so each row yields a row again; those with equal payloads are all responses
if theirs is the largest page_id. Records without a page_id are responses. An empty table makes an
empty archive and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import sliced, written

MIN_SHARED_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Records are written as rows of about this many bytes, and so many rows to a file, which a reader holds at once.
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 32
#: Digests with copies are broadcast up to this many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_ROWS = 50_000
SALTS = 16

_EOL = b"\r\n"
_PART = pa.schema(
    [("page_id", pa.int64()), ("row", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("record_type", pa.string()), ("stated", pa.string()), ("block", pa.binary())]
)
_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


# --- records ---------------------------------------------------------------


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in the chunked transfer coding."""
    parts = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        parts += [b"%x" % len(piece), _EOL, piece, _EOL]
    return b"".join([*parts, b"0", _EOL, _EOL])


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(_EOL, at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != _EOL:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(data[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record but for the last line end, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + _EOL + block + _EOL


def _target(url: str | None) -> str:
    return "".join(c for c in (url or "about:blank") if c > " ")


def page_records(page_id, row: str, url: str, payload: bytes, kept: dict | None, date: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response in segments.

    ``kept`` tells of the response of equal payloads, if there are several: its ``keeper``
    (page_id), ``keeper_url``, and ``times``, the rows that are just like it.
    """
    digest = hashlib.sha1(payload).hexdigest()
    named = kept is not None and kept["times"] == 1
    revisits = kept is not None and page_id not in (None, kept["keeper"])
    name = f"urn:page:{'' if page_id is None else page_id}:{digest if named and not revisits else row}"
    target = _target(url)
    fields = [
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisits:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        more = [
            ("WARC-Type", "revisit"),
            ("WARC-Refers-To-Target-URI", _target(kept["keeper_url"])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page", kept["keeper"]),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
        if named:
            more.insert(1, ("WARC-Refers-To", f"<urn:page:{kept['keeper']}:{digest}>"))
        return [_record(more + fields, block)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *fields], block)]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"), ("WARC-Date", date), ("WARC-Target-URI", target)]
        out.append(_record([*own, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", k), *last], piece))
    return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive file."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


# --- writing ---------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, kept): kept tells of the page that holds an equal payload, if several have it.

    Only digests are aggregated. The digests with copies are broadcast if their
    counted rows are few; otherwise they are replicated ``SALTS`` times, so that a
    payload of a third of all pages is joined in many tasks.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    of_page = keyed.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("times"), F.max("url").alias("keeper_url"))
    copies = (
        of_page.groupBy("digest", "bytes")
        .agg(F.sum("times").alias("n"), F.max(F.struct(F.col("page_id").alias("keeper"), "keeper_url", "times")).alias("kept"))
        .filter("n > 1 and kept.keeper is not null")
        .select("digest", "bytes", "kept")
    )
    copies = written(copies, "warc-copies")
    if copies.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = keyed.join(F.broadcast(copies), ["digest", "bytes"], "left")
    else:
        salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "bytes", "salt"], "left")
    return joined.select("page_id", "url", "payload", "kept")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_bytes: int = MIN_SHARED_BYTES, date: str | None = None) -> None:
    """Writes the pages as uncompressed archive files under ``path``, dated now or with a given time."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def records(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in sliced(batches, 256):
            for page_id, url, payload, kept in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for record in page_records(page_id, f"{part}-{n}", url, payload, kept, date, segment_bytes):
                    if held and size + len(record) > ROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([_EOL.join(held)], pa.binary())], names=["record"])
                        held, size = [], 0
                    held.append(record)
                    size += len(record)
                n += 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_EOL.join(held)], pa.binary())], names=["record"])

    made = with_revisits(pages, min_bytes).mapInArrow(records, "record binary")
    # the writer ends each row with one more line end; bytes pass through a string column unchanged
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


# --- reading ---------------------------------------------------------------


def _size(page_id, kind: str, stated: str | None, block: bytes) -> int:
    """Bytes of the full payload, after a check of the stated digest; a revisit states its size."""
    if kind == "revisit":
        head = block.lower()
        at = head.index(b"content-length:") + 15
        return int(head[at : head.index(b"\r\n", at)])
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError(f"page {page_id}: the payload isn't the one recorded")
    return len(payload)


def _ids(urn: str):
    """(page_id, row) of a record's identifier."""
    parts = urn.strip("<>").split(":")
    return (int(parts[2]) if parts[2] else None), (parts[3] if len(parts) > 3 else "")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page in the archives under ``path``, segments put together.

    Raises if a record or chunk is malformed, a segment is missing, the total length
    is wrong, or a payload doesn't have the digest that its record states.
    """

    def parts(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for f, block in parsed(data.as_buffer().to_pybytes()):
                    kind = f["warc-type"]
                    page_id, row = _ids(f.get("warc-segment-origin-id", f["warc-record-id"]))
                    refers_to = int(f["x-refers-to-page"]) if kind == "revisit" else None
                    segment = int(f.get("warc-segment-number", 0))
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if segment == 0:
                        out.append((page_id, row, 0, _size(page_id, kind, stated, block), refers_to, kind, stated, None))  # its block stays here
                    else:
                        out.append((page_id, row, segment, total, None, kind, stated, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, _PART.types, strict=True)], schema=_PART)

    def joined(batches):
        for batch in batches:
            out = []
            for page_id, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not segments[0]["segment"]:
                    out += [(page_id, s["total"], s["stated"], s["record_type"], s["refers_to"]) for s in segments]
                    continue
                block = b"".join(s["block"] for s in segments)
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                    raise ValueError(f"page {page_id}: segments are missing")
                stated = segments[0]["stated"]
                out.append((page_id, _size(page_id, "response", stated, block), stated, "response", None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _PAGE.types, strict=True)], schema=_PAGE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(parts, "page_id bigint, row string, segment int, total bigint, refers_to bigint, record_type string, stated string, block binary")
    # one group for each record: a whole one is a small row by now
    return (
        found.groupBy("page_id", "row")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "total", "stated", "record_type", "refers_to", "block"))).alias("segments"))
        .select("page_id", "segments")
        .mapInArrow(joined, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    )


#: What comes back, in DuckDB's SQL.
SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as n, sha1(h) as d, max(page_id) over (partition by h) as k from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
       case when n >= {MIN_SHARED_BYTES} and k <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= {MIN_SHARED_BYTES} and k <> page_id then k end as refers_to
from q
"""
