"""WARC archives: deduplicating writer and salvage reader.

Records are written as gzip members by Spark's text writer, so archives may lie in any store Spark can
write to; between two members stands an empty member, which readers of gzip skip. The reader checks every
record. After a failed check it searches for the next valid member or version line, goes on there and
logs the bytes between as quarantined. The same holds for the content of a member: records around a bad one
are kept. Of a member that does not inflate to its end, or fails its own check, the records are kept whose
block digest is right (header lines have no digest); of one that is only cut off, all whole records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 10_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16
_CUT = "unfinished member"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    lines.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``digest``, ``refers_to``.

    Of equal payloads of REVISIT_BYTES bytes or more the largest page_id is stored (its repeated rows too),
    the others refer to it. Null html is an empty payload. A row without page_id refers to the largest
    id of its group; without any id in the group all are stored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn(
        "key", F.when(F.octet_length("html") >= REVISIT_BYTES, F.col("digest"))
    )
    kept = (
        rows.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 AND kept IS NOT NULL").select("key", "kept")
    )
    older = F.coalesce(F.col("page_id") < F.col("kept"), F.col("kept").isNotNull())
    return rows.join(kept, "key", "left").select(
        "page_id", "url", "html", "digest", F.when(older, F.col("kept")).alias("refers_to")
    )


def write(pages: DataFrame, path: str) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) into archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members: list[bytes] = []
            size = 0
            for page_id, url, html, digest, refers_to in zip(*batch.columns):
                data = member(record(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), digest.as_py()))
                members.append(data)
                size += len(data)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])
                    members, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])

    planned = plan_records(pages).withColumn("html", F.col("html").cast("binary"))
    (
        planned.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string"))  # the bytes stay as they are
        .write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1"))
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


class Damaged(Exception):
    """A record that fails a check."""


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def _digest(field: str | None) -> bytes | None:
    if not field or not field.startswith("sha1:"):
        return None
    try:
        return base64.b32decode(field[5:])
    except ValueError as error:
        raise Damaged("unreadable digest") from error


def _parse(data: bytes | memoryview, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and the index behind it."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("unfinished header")
    lines = data[at:end].split(b"\r\n")
    if not lines[0].startswith(VERSION):
        raise Damaged("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header line")
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("wrong content length")
    found = Record(fields, data[start:stop])
    expected = _digest(fields.get("warc-block-digest"))
    if expected is not None and hashlib.sha1(found.block).digest() != expected:
        raise Damaged("wrong block digest")
    if fields.get("warc-type") == "response":
        expected = _digest(fields.get("warc-payload-digest"))
        if expected is not None and hashlib.sha1(found.payload()).digest() != expected:
            raise Damaged("wrong payload digest")
    return found, stop + 4


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` inflates to, the index behind the member, and what is wrong with it."""
    opener = zlib.decompressobj(31)
    parts = []
    p = at
    try:
        while not opener.eof:
            if p >= len(data):
                return b"".join(parts), p, _CUT
            parts.append(opener.decompress(data[p : p + _STEP]))
            p += _STEP
    except zlib.error:
        opener = zlib.decompressobj(31)
        parts = [opener.decompress(data[k : k + _STEP]) for k in range(at, p, _STEP)]
        try:
            # Byte by byte, as the call that fails gives nothing.
            for k in range(p, min(p + _STEP, len(data))):
                parts.append(opener.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(parts), p, "damaged member"
    return b"".join(parts), min(p, len(data)) - len(opener.unused_data), None


def _behind(data: bytes, at: int, size: int) -> int:
    """The index behind the bytes of the member at ``at`` that its first ``size`` bytes of content need."""
    opener = zlib.decompressobj(31)
    while size > 0:
        part = data[at : at + _STEP]
        size -= len(opener.decompress(part, size))
        at += len(part) - len(opener.unconsumed_tail)
    return at


def _parse_content(content: bytes, whole: bool) -> tuple[list[Record | tuple[int, int, str]], int]:
    """Valid records and gaps of a member's content, and the index behind the last record."""
    found: list[Record | tuple[int, int, str]] = []
    at = good = 0
    reason = ""
    while at < len(content):
        try:
            one, stop = _parse(content, at)
            if not whole and "warc-block-digest" not in one.fields:
                raise Damaged("no block digest in a damaged member")
        except Damaged as error:
            reason = reason or str(error)
            at = content.find(VERSION, at + 1)
            if at < 0:
                break
            continue
        if reason:
            found.append((good, at, reason))
            reason = ""
        found.append(one)
        at = good = stop
    if reason:
        found.append((good, len(content), reason))
    return found, good


def _read_at(data: bytes, at: int) -> tuple[list[Record | tuple[int, int, str]], int, str | None]:
    """Records and gaps at ``at``, the index to go on from, and the reason if a damaged member is left there."""
    if data.startswith(MAGIC, at):
        content, stop, fault = _unpack(data, at)
        found, good = _parse_content(content, fault in (None, _CUT))
        if not good and (content or fault):
            raise Damaged(fault or found[0][2])
        if fault:
            stop = _behind(data, at, good)
            if not isinstance(found[-1], Record):
                found.pop()  # what follows the last record is left for the caller
        return [
            x if isinstance(x, Record) else (at, stop, f"{x[2]}, content bytes {x[0]} to {x[1]}") for x in found
        ], stop, fault
    if data.startswith(VERSION, at):
        one, stop = _parse(data, at)
        return [one], stop, None
    raise Damaged("neither a member nor a version line")


_NEXT = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All valid records in order, and (start, stop, reason) of each gap that was quarantined.

    A gap in a member's content has the place of the member, and its own in the reason.
    """
    at = 0
    while at < len(data):
        try:
            records, at, reason = _read_at(data, at)
            yield from records
            if not reason:
                continue
            search = at
        except Damaged as error:
            reason = str(error)
            search = at + 1
        start = at
        while True:
            found = _NEXT.search(data, search)
            if not found:
                at = len(data)
                break
            at = found.start()
            try:
                _read_at(data, at)
                break
            except Damaged:
                search = at + 1
        yield start, at, reason


_READ = (
    "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, gap_start long, gap_stop long, reason string"
)


def _number(field: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
    return int(found[1]) if found else None


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of all archives below ``path``: one per valid record, and one per quarantined gap (``reason`` set).

    Empty and wholly damaged archives do not fail; they give no record, or one gap.
    """

    def row(archive: str, found: Record) -> dict:
        f = found.fields
        length = re.search(rb"(?im)^content-length:\s*(\d+)", found.block.partition(b"\r\n\r\n")[0])
        digest = _digest(f.get("warc-payload-digest"))
        return {
            "archive": archive, "page_id": _number(f.get("warc-record-id")), "url": f.get("warc-target-uri"),
            "record_type": f.get("warc-type"), "refers_to": _number(f.get("warc-refers-to")),
            "payload_bytes": int(length[1]) if length else len(found.payload()),
            "payload_digest": digest.hex() if digest else None,
            "payload": found.payload() if with_payload and f.get("warc-type") == "response" else None,
        }

    kinds = [("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("payload", pa.binary()), ("gap_start", pa.int64()), ("gap_stop", pa.int64()), ("reason", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(*batch.columns):
                rows: list[dict] = []
                size = 0
                for found in salvage(data.as_py() or b""):
                    if isinstance(found, Record):
                        rows.append(row(archive.as_py(), found))
                        size += len(rows[-1]["payload"] or b"")
                    else:
                        rows.append({"archive": archive.as_py(), "gap_start": found[0], "gap_stop": found[1], "reason": found[2]})
                    if len(rows) >= 5000 or size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _READ)
