"""WARC archives: a writer with identical-payload revisits and a salvage reader.

Archives are sequences of gzip members, one record each; plain ones are read as well. The reader checks the member (gzip's
CRC-32 and length), the version line, the header lines, Content-Length, the record's end, the block digest of every record,
of a response the payload digest, and of own records the ids and a digest of the header lines, which the format itself doesn't have. Where a check fails it looks for the next place at which a member or
a version line begins and a whole record passes, goes on from there, and logs the bytes between as a quarantined gap with the
reason. Only the record at hand is in memory; a block longer than `most` bytes or a header longer than `top` is a failed check.
The writer states its longest of both, and by these its own archives are read, so no page of theirs is beyond a limit.

Nulls: a null html is an empty payload, a null page_id sorts below all others and is written as an empty id, a null url
as about:blank. Rows with equal page_ids are separate records, each judged by its payload. Columns besides page_id, url
and html are ignored; empty tables give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_bytes, materialize, open_in, open_out, shared_dir, table

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Own records' last header line, over all lines before it.
HEADER_DIGEST = b"X-Header-Digest: sha1:"
CHUNK = 1 << 20
#: Bytes of uncompressed payload after which a file ends.
FILE_BYTES = 256 << 20
#: Limits for archives whose writer has stated none: bytes of a block, bytes of a header.
MOST, TOP = 256 << 20, 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


OWN_URI = re.compile(r"<urn:page:(-?[0-9]{1,19})?:[A-Z2-7]{32}>")


def page_of(uri: str) -> int | None:
    """The page_id that an own record's id holds; None for a null one and for any other id."""
    own = OWN_URI.fullmatch(uri)
    return int(own[1]) if own and own[1] and -(1 << 63) <= int(own[1]) < 1 << 63 else None


def record_parts(page_id: int | None, url: str | None, payload: bytes, revisit_of: tuple[int | None] | None) -> tuple[bytes, bytes]:
    """Header, with the empty line that ends it, and block of a record."""
    digest = sha1_base32(payload)
    block = HTTP_HEAD % len(payload) + (b"" if revisit_of else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit_of else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit_of:
        head += [f"WARC-Refers-To: {record_uri(revisit_of[0], digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines = "\r\n".join(head).encode()
    return lines + b"\r\n" + HEADER_DIGEST + sha1_base32(lines).encode() + b"\r\n\r\n", block


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: tuple[int | None] | None, compress: bool = True) -> bytes:
    """A response, or with revisit_of = (page_id of the response,) a revisit without the payload."""
    head, block = record_parts(page_id, url, payload, revisit_of)
    data = head + block + b"\r\n\r\n"
    return member(data) if compress else data


class BadRecord(ValueError):
    pass


@dataclass
class Record:
    begin: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def payload(self) -> bytes:
        at = self.block.find(b"\r\n\r\n")
        return self.block[at + 4 :] if at >= 0 and self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    begin: int
    end: int
    reason: str


@dataclass
class _Window:
    """A sliding view of a stream; data[0] is byte `base`."""

    stream: BinaryIO
    base: int = 0
    data: bytearray = field(default_factory=bytearray)
    done: bool = False

    def more(self) -> bool:
        got = b"" if self.done else self.stream.read(CHUNK)
        self.done = not got
        self.data += got
        return not self.done

    def reach(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n

    def seek(self, at: int) -> None:
        if not self.base <= at <= self.base + len(self.data):
            self.stream.seek(at)
            self.base, self.data, self.done = at, bytearray(), False
        else:
            self.drop(at - self.base)


def _plain_record(data: bytearray | bytes, whole: bool, most: int, top: int) -> tuple[int, dict[str, str], bytes] | None:
    """(bytes used, headers, block) of a record at the start of data; None: more data are needed."""
    if len(data) >= 7 and not data.startswith(VERSION):
        raise BadRecord("no version line")
    head = data.find(b"\r\n\r\n", 0, top)
    if head < 0:
        if whole or len(data) >= top:
            raise BadRecord("the header does not end")
        return None
    lines = bytes(data[:head]).split(b"\r\n")
    if lines[-1].startswith(HEADER_DIGEST):
        if lines[-1][len(HEADER_DIGEST) :] != sha1_base32(b"\r\n".join(lines[:-1])).encode():
            raise BadRecord("the header digest differs")
    elif any(line.lower().startswith(b"warc-record-id:") and b"<urn:page:" in line for line in lines):
        raise BadRecord("the header digest is missing")
    if not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise BadRecord("a damaged version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.^-z|~0-9A-Z]+", name):
            raise BadRecord("a damaged header line")
        try:
            headers[name.decode().lower()] = value.strip().decode()
        except UnicodeDecodeError:
            raise BadRecord("a damaged header line") from None
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise BadRecord("no Content-Length")
    size = int(headers["content-length"])
    if size > most:
        raise BadRecord("a record beyond the size limit")
    end = head + 4 + size + 4
    if len(data) < end:
        if whole:
            raise BadRecord("the record ends early")
        return None
    if data[end - 4 : end] != b"\r\n\r\n":
        raise BadRecord("the record does not end where it should")
    return end, headers, bytes(data[head + 4 : end - 4])


def _verify(headers: dict[str, str], block: bytes, record: Record) -> Record:
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != sha1_base32(block):
        raise BadRecord("the block digest differs")
    want = headers.get("warc-payload-digest", "")
    if want.startswith("sha1:") and record.kind == "response" and want[5:] != sha1_base32(record.payload()):
        raise BadRecord("the payload digest differs")
    return record


def _one(w: _Window, most: int, top: int) -> Record | None:
    """The record at the window's start, checked; the window moves past it. None at the end. Raises BadRecord, the window unmoved."""
    w.reach(len(VERSION))
    if not w.data:
        return None
    begin = w.base
    if w.data.startswith(GZIP):
        z, out, used = zlib.decompressobj(31), bytearray(), 0
        try:
            while not z.eof:
                if used == len(w.data) and not w.more():
                    raise BadRecord("the member ends early")
                piece = bytes(w.data[used : used + CHUNK])
                out += z.decompress(piece, most + 2 * top - len(out))
                used += len(piece) - len(z.unconsumed_tail)
                if not z.eof and len(out) >= most + 2 * top:
                    raise BadRecord("a record beyond the size limit")
        except zlib.error as e:
            raise BadRecord(f"a damaged member: {str(e).rpartition(':')[2].strip()}") from None
        used -= len(z.unused_data)
        end, headers, block = _plain_record(out, True, most, top)
        if end != len(out):
            raise BadRecord("more than a record in a member")
        record = _verify(headers, block, Record(begin, begin + used, headers, block))
        w.drop(used)
        return record
    while True:
        found = _plain_record(w.data, w.done, most, top)
        if found:
            end, headers, block = found
            record = _verify(headers, block, Record(begin, begin + end, headers, block))
            w.drop(end)
            return record
        w.more()


def _next(w: _Window, after: int) -> int | None:
    """The first place from `after` on where a member or version line may begin."""
    w.seek(after)
    while True:
        places = [p for p in (w.data.find(GZIP), w.data.find(VERSION)) if p >= 0]
        if places:
            at = w.base + min(places)
            w.drop(min(places))
            return at
        keep = max(0, len(w.data) - len(VERSION) + 1)
        w.drop(keep)
        if not w.more():
            return None


def salvage(stream: BinaryIO, most: int = MOST, top: int = TOP) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order; together they cover every byte."""
    w = _Window(stream)
    while True:
        try:
            record = _one(w, most, top)
            if record is None:
                return
            yield record
            continue
        except BadRecord as e:
            bad, reason = w.base, str(e)
        at: int | None = bad
        while True:
            at = _next(w, at + 1)
            if at is None:
                yield Gap(bad, w.base + len(w.data), reason)
                return
            try:
                record = _one(w, most, top)
            except BadRecord:
                w.seek(at)
                continue
            yield Gap(bad, at, reason)
            if record is not None:
                yield record
            break


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, refers (the response's page_id), is_revisit.

    Digests are counted with partial aggregation; the digests that occur more than once are written out, and the pages
    join them. Neither side of that join is aggregated above its exchange, so Spark can split a hot digest's partition.
    """
    key = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").withColumn("digest", key)
    again = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers")
    joined = rows.join(materialize(again, "warc-digests"), "digest", "left")
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    return joined.withColumn("is_revisit", F.coalesce(big & (F.col("page_id") < F.col("refers")) | big & F.col("page_id").isNull() & F.col("refers").isNotNull(), F.lit(False)))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Archives of the planned records; a row per file with path, records, bytes, and the bytes of its longest block and header. Files of lost tasks are in no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = stream = None
        count = size = raw = most = top = 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64()), "most": pa.array([most], pa.int64()), "top": pa.array([top], pa.int64())})

        for batch in by_bytes(batches, "html"):
            for page_id, url, html, refers, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers", "is_revisit"))):
                if stream is None:
                    path, stream = open_out(folder, f"{uuid.uuid4().hex}.warc.gz")
                    count = size = raw = most = top = 0
                head, block = record_parts(page_id, url, (html or "").encode(), (refers,) if revisit else None)
                data = member(head + block + b"\r\n\r\n")
                stream.write(data)
                most, top = max(most, len(block)), max(top, len(head))
                count, size, raw = count + 1, size + len(data), raw + len(html or "")
                if raw >= FILE_BYTES:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return planned.select("page_id", "url", "html", "refers", "is_revisit").mapInArrow(run, "path string, records long, bytes long, most long, top long")


SCHEMA = "path string, begin long, end long, gap_reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def read_archives(files: DataFrame, payloads: bool = False, most: int = MOST) -> DataFrame:
    """A row per record and per quarantined gap of the files in column path; gap_reason is null for records.

    Columns most and top of files, where there, raise the limits of a file to what its writer wrote.
    """
    tasks = max(2, files.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, own, head in zip(*(batch.column(c).to_pylist() for c in ("path", "most", "top"))):
                rows, size = [], 0
                with open_in(path) as f:
                    for x in salvage(f, max(most, own or 0), max(TOP, head or 0)):
                        rows.append((path, x.begin, x.end, *(described(x, payloads) if isinstance(x, Record) else (x.reason, *[None] * 7))))
                        size += len(rows[-1][-1] or "") + 200
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    stated = [F.col(c) if c in files.columns else F.lit(None).cast("long").alias(c) for c in ("most", "top")]
    return files.select("path", *stated).repartition(tasks, "path").mapInArrow(run, SCHEMA)


def described(r: Record, payloads: bool) -> tuple[Any, ...]:
    h = r.headers
    target = h.get("warc-target-uri")
    own = page_of(h.get("warc-record-id", ""))
    refers = page_of(h.get("warc-refers-to", "")) if r.kind == "revisit" else None
    if r.kind == "revisit":
        length = h.get("x-payload-length", "")
        return None, own, target, r.kind, refers, int(length) if re.fullmatch("[0-9]{1,18}", length) else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    payload = r.payload()
    return None, own, target, r.kind, refers, len(payload), sha1_base32(payload), payload.decode("utf-8", "replace") if payloads else None


def checked(found: DataFrame, files: DataFrame) -> DataFrame:
    """The records of `found`, what read_archives() gives of own archives; found is written, gaps included. Raises if there is a gap or a record is missing."""
    held = materialize(found.drop("payload"), "warc-read")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    records, gaps = held.agg(F.count_if(F.col("gap_reason").isNull()), F.count_if(F.col("gap_reason").isNotNull())).first()
    if gaps or records != written:
        raise RuntimeError(f"{records} of {written} records written were read, with {gaps} gaps; they are listed in {held.__dict__['_scratch']}")
    return held.where("gap_reason is null")


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    files = materialize(write_archives(plan_records(table(spark, sf_dir, "pages")), folder), "warc-files")
    return checked(read_archives(files), files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc_salvage": op2_warc_salvage}
#: DuckDB has hexadecimal SHA-1 only: each group of 5 hexadecimal digits makes 4 base32 digits.
ORACLE_SQL = {
    "op2_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((('0x' || substr(hex, CAST(1 + (i // 4) * 5 AS INT), 5))::INT // CAST(pow(32, 3 - i % 4) AS INT)) % 32 + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
}
