"""Legacy ARC archives and their conversion to WARC.

An ARC file begins with a version block that names the fields of its header lines: version 1 has
``URL IP date type length``, version 2 has five more before the length. Records follow, each a
header line and as many bytes as it declares. ``convert`` makes WARC records of them, with record
ids, timestamps, types and digests derived from what the ARC record says.

Files are written by Spark's text sink, which writes the bytes of a column as they are; a
record's closing line ends are the sink's line separator. They are read back as binary files, a
file per task, decompressed and parsed as a stream. Archives lie in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed.session import broadcast_if_small, settle, shared_dir

# --- fixed values: the formats ---
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
PAGE_HEADER = "X-Page-Id"
# --- end of fixed values ---

CHUNK = 1 << 20
COMPRESSION = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class ArchiveError(ValueError):
    """A file that is not a well-formed archive."""


class Reader:
    """Lines and byte counts out of a plain or gzip-compressed file, a chunk at a time."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0
        self.gzip = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.buffer = bytearray()
        self.low = 0

    def _more(self) -> bool:
        if self.low > 4 * CHUNK:
            del self.buffer[:self.low]
            self.low = 0
        if not self.gzip:
            chunk = self.content[self.at:self.at + CHUNK]
            self.at += len(chunk)
            self.buffer += chunk
            return bool(chunk)
        while True:
            if self.inflate.eof:  # archives may have a member per record
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
            chunk = self.content[self.at:self.at + CHUNK // 4]
            if not chunk:
                return False
            self.at += len(chunk)
            out = self.inflate.decompress(chunk)
            self.buffer += out
            if out:
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = self.low
        while True:
            end = self.buffer.find(b"\n", seen)
            if end >= 0:
                out = bytes(self.buffer[self.low:end])
                self.low = end + 1
                return out.removesuffix(b"\r")
            seen = len(self.buffer)
            before = self.low
            if not self._more():
                rest = bytes(self.buffer[self.low:])
                self.low = len(self.buffer)
                return rest or None
            seen -= before - self.low

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.low < n:
            if not self._more():
                raise ArchiveError(f"{n - len(self.buffer) + self.low} bytes are missing")
        out = bytes(self.buffer[self.low:self.low + n])
        self.low += n
        return out


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    version: int


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first. A file without bytes, as an empty
    table leaves, holds none."""
    reader, version = Reader(content), 0
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace")
        if not version:
            # The version block declares the fields, its own line has those of version 1 or 2.
            parts = text.rsplit(" ", 4 if text.count(" ") < 9 else 9)
            block = reader.take(_length(parts[-1], text))
            declared = block.split(b" ", 1)[0]
            if not parts[0].startswith("filedesc:") or not declared.isdigit() or int(declared) not in ARC_FIELDS:
                raise ArchiveError(f"no version block: {text[:80]!r}")
            version = int(declared)
        else:
            # From the right, because old URLs may hold blanks.
            parts = text.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
            if len(parts) != len(ARC_FIELDS[version].split()):
                raise ArchiveError(f"fields are missing: {text[:80]!r}")
            block = reader.take(_length(parts[-1], text))
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], block, version)


def _length(field: str, line: str) -> int:
    if not field.isdigit():
        raise ArchiveError(f"no length: {line[:80]!r}")
    return int(field)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP message; no head for anything else."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return b"", block
    return block[:end + 4], block[end + 4:]


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?mi)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """ISO time of an ARC date of 14 digits, or fewer from the left; the epoch if it has none."""
    padded = (date + "00000101000000"[len(date):]) if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{padded[:4]}-{padded[4:6]}-{padded[6:8]}T{padded[8:10]}:{padded[10:12]}:{padded[12:14]}Z"


def record_id(file: str, place: int, record: ArcRecord) -> str:
    """An id that depends on the record and where it stood, so a conversion can be repeated."""
    name = f"{file}\0{place}\0{record.url}\0{record.date}\0{digest(record.block)}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}>"


def warc_type(record: ArcRecord) -> str:
    if record.url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if split_http(record.block)[0] else "resource"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing line ends."""
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def to_warc(file: str, place: int, record: ArcRecord, refers: tuple[str, str, str] | None) -> bytes:
    """The WARC form of an ARC record. ``refers``: id, URL and date of the record whose payload
    it repeats, which makes it a revisit that keeps only the head."""
    kind = warc_type(record)
    head, payload = split_http(record.block)
    block = record.block
    fields = [
        ("WARC-Type", "revisit" if refers else kind), ("WARC-Record-ID", record_id(file, place, record)),
        ("WARC-Date", warc_date(record.date)),
    ]
    if kind == "warcinfo":
        fields += [("Content-Type", "application/warc-fields")]
        block = f"software: arc conversion\r\nformat: WARC 1.0\r\nconverted-from: ARC {record.version}\r\n".encode()
        return warc_record(fields, block)
    fields += [("WARC-Target-URI", record.url), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if record.ip not in ("0.0.0.0", "-", ""):
        fields += [("WARC-IP-Address", record.ip)]
    if refers:
        block = head
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2]),
        ]
    fields += [
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.kind),
    ]
    return warc_record(fields, block)


class WarcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def read_warc(content: bytes) -> Iterator[WarcRecord]:
    reader = Reader(content)
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while line := reader.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield WarcRecord(fields, reader.take(_length(fields.get("content-length", ""), "record without length")))


# --- Spark ---------------------------------------------------------------------------------


def _write(records: DataFrame, path: str, end: str) -> None:
    """The records of each partition, in order, as one file."""
    records.select(F.col("record").cast("string").alias("record")).write.options(lineSep=end, **COMPRESSION).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC files, one per partition, versions 1 and 2 in turn.

    NULL html is an empty payload, blanks in URLs are escaped, a NULL URL becomes ``about:blank``.
    The id travels in a header of the HTTP message; a NULL id has none.
    """
    source = pages.select(
        pages[page_id].cast("bigint"), F.coalesce(pages[url].cast("string"), F.lit("about:blank")),
        F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary"),
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        version = part % 2 + 1
        about = f"{version} 0 rolefeed\n{ARC_FIELDS[version]}\n".encode()
        start = f"filedesc://part-{part}.arc 0.0.0.0 20240101000000 text/plain {len(about)}\n".encode() + about
        # A partition without pages is an archive of its version block.
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.binary())], names=["record"])
        for batch in batches:
            out = []
            for one, where, body in zip(*(c.to_pylist() for c in batch.columns)):
                named = "" if one is None else f"{PAGE_HEADER}: {one}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}"
                        f"Content-Length: {len(body)}\r\n\r\n").encode()
                where = "".join(f"%{ord(c):02X}" if c <= " " else c for c in where) or "about:blank"
                date = 20240101000000 + (one or 0) % 28 * 1000000
                more = "" if version == 1 else " 200 - - 0 -"
                out.append(f"{where} 0.0.0.0 {date} text/html{more} {len(head) + len(body)}\n".encode() + head + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(source.mapInArrow(run, "record binary"), path, ARC_END)


HEADS = """path string, place bigint, record_id string, page_id bigint, url string, date string,
  payload_bytes bigint, payload_digest string"""


def _heads(batches):
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            for place, record in enumerate(read_arc(content)):
                head, payload = split_http(record.block)
                if head:
                    one = http_field(head, PAGE_HEADER)
                    rows.append((path, place, record_id(path, place, record), int(one) if one else None,
                                 record.url, warc_date(record.date), len(payload), digest(payload)))
            if rows:
                names = ("path", "place", "record_id", "page_id", "url", "date", "payload_bytes", "payload_digest")
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Which records repeat the payload of which: of equal payloads of at least ``least_bytes``,
    all but the one with the largest page id (then the largest record id). Only the best of a
    payload is aggregated, so a payload that a third of all records share is no hot spot."""
    equal = ["payload_digest", "payload_bytes"]
    large = heads.where(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "url", "date")
    first = large.groupBy(*equal).agg(F.max(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    return large.join(first, equal).where("record_id <> first.record_id").select(
        "path", "place", F.col("first.record_id").alias("to_id"),
        F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"),
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """All ARC files of a folder as WARC files, one for each, repeated payloads as revisits.

    Payloads are never shuffled: heads are read in a first pass, and the second gets a list of
    revisits per file, which is no longer than the file."""
    heads = settle(_files(spark, arc_path).mapInArrow(_heads, HEADS))
    again = revisits(heads, least_bytes)
    lists = settle(again.groupBy("path").agg(F.collect_list(F.struct("place", "to_id", "to_url", "to_date")).alias("again")))
    files = _files(spark, arc_path).join(broadcast_if_small(lists), "path", "left").select("path", "content", "again")

    def run(batches):
        for batch in batches:
            for path, content, listed in zip(*(c.to_pylist() for c in batch.columns)):
                refers = {x["place"]: (x["to_id"], x["to_url"], x["to_date"]) for x in listed or []}
                out, size = [], 0
                for place, record in enumerate(read_arc(content)):
                    out.append(to_warc(path, place, record, refers.get(place)))
                    size += len(out[-1])
                    if size > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(files.mapInArrow(run, "record binary"), warc_path, WARC_END)


FOUND = """record_id string, page_id bigint, payload_bytes bigint, payload_digest string,
  record_type string, to_id string"""


def _found(batches):
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for fields, block in read_warc(content):
                head, payload = split_http(block)
                kind = fields["warc-type"]
                if kind not in ("response", "revisit") or not head:
                    continue
                sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != sha1:
                    raise ArchiveError(f"payload of {fields['warc-record-id']} is damaged")
                size = len(payload) if kind == "response" else int(http_field(head, "Content-Length") or 0)
                one = http_field(head, PAGE_HEADER)
                rows.append((fields["warc-record-id"], int(one) if one else None, size, sha1, kind, fields.get("warc-refers-to")))
            if rows:
                names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "to_id"]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_pages(spark: SparkSession, warc_path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every response and
    revisit in the WARC files of a folder. Payloads are checked against their digests."""
    found = settle(_files(spark, warc_path).select("content").mapInArrow(_found, FOUND))
    targets = found.select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    wanted = found.where("to_id is not null").select("to_id").distinct()
    targets = settle(targets.join(wanted, "to_id", "left_semi"))
    return found.join(broadcast_if_small(targets), "to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    base = shared_dir(spark)
    write_arc(pages, f"{base}/arc")
    convert(spark, f"{base}/arc", f"{base}/warc", least_bytes)
    return read_pages(spark, f"{base}/warc")
