"""WARC archives: a writer, and a reader that splits compressed archives by byte ranges.

Writing. Every page becomes one gzip member. Of pages with equal payloads (of `least` bytes or more) that with
the smallest id is a response; the others are revisit records that name it and carry no payload. The digests
are grouped with map-side partial minima; only repeated ones are joined back. Each task attempt writes a file of
its own and reports it; the stored list of reported files is the archive, so files of lost or repeated
attempts are never read.

Reading. The list of files is cut in ranges of `range_bytes`, one task row each. A task scans its range for the
gzip magic, decodes the head of each candidate member, and takes it as a record if it is a WARC header.
It owns the records that start inside the range and reads on past the end to finish the last one; a record's members
are skipped, not scanned. So each record is read once, however ranges fall, and only one record is
held at a time.

Defined results: a null html is an empty payload; a page without an id is a response, refers to nothing and is never
referred to; rows with one id and payload are ties: those with the smallest id are all responses; line ends and blanks
in a url are percent-encoded; an empty table gives an archive without records; other columns are ignored.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.common import scratch_path, stored

RANGE_BYTES = 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "record_type string, page_id long, refers_to long, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, path string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response, or a revisit of page `first` if that is another page."""
    revisit = first is not None and page_id is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{page_urn(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Refers-To: <{page_urn(first)}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def written(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes an archive of page_id, url, html below folder; path, size and records of its files."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digests = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    repeated = stored(repeated, "repeated-payloads")
    rows = rows.withColumn("digest", F.sha1("payload")).join(repeated, "digest", "left").select("page_id", "url", "payload", "first")

    def write(batches):
        path, size, count, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(name) for name in ("page_id", "url", "payload", "first"))):
                if out is None:
                    system, place = fs.FileSystem.from_uri(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "size", "records"])

    return stored(rows.mapInArrow(write, "path string, size long, records long"), "warc-files")


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


class _Ended(ValueError):
    """A member has no more bytes."""


class Member:
    """A gzip member read from a place on; `head` is None if it is not the start of a WARC record."""

    def __init__(self, source, offset: int):
        self.source, self.at, self.unpack = source, offset, zlib.decompressobj(31)
        self.text, self.head, self.end = b"", None, None
        try:
            while b"\r\n\r\n" not in self.text and self._more(1024 if not self.text else _CHUNK):
                if not b"WARC/1.".startswith(self.text[:7]) and not self.text.startswith(b"WARC/1."):
                    return
            head, found, self.text = self.text.partition(b"\r\n\r\n")
            if found and head.startswith(b"WARC/1."):
                self.head = header_fields(head)
        except (zlib.error, _Ended):
            # Not a record: what looks like a member's start may stand in another one, near the end of a file.
            self.head = None

    def _more(self, size: int) -> bool:
        if self.unpack.eof:
            self.end = self.at - len(self.unpack.unused_data)
            return False
        raw = self.source.read_at(size, self.at)
        if not raw:
            raise _Ended("an archive ends within a record")
        self.at += len(raw)
        self.text += self.unpack.decompress(raw)
        return True

    def block(self) -> bytes:
        parts, self.text = [self.text], b""
        while self._more(_CHUNK):
            parts.append(self.text)
            self.text = b""
        return b"".join(parts)[: int(self.head["content-length"])]


class _Source:
    """Random access to a file, one chunk remembered."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        self.size, self.start, self.held = self.file.size(), 0, b""

    def read_at(self, size: int, at: int) -> bytes:
        if not self.start <= at < self.start + len(self.held):
            self.start, self.held = at, self.file.read_at(min(_CHUNK, self.size - at), at) if at < self.size else b""
        return self.held[at - self.start : at - self.start + size]


def records_in(source: _Source, start: int, end: int):
    """(offset, fields, block) of the records that start in [start, end)."""
    at = start
    while at < end:
        raw = source.read_at(_CHUNK, at)
        if not raw:
            return
        found = raw.find(_MAGIC)
        if found < 0:
            # A magic may lie across two chunks.
            at += max(1, len(raw) - len(_MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        member = Member(source, at) if len(source.read_at(len(_MAGIC), at)) == len(_MAGIC) else None
        if member is None or member.head is None:
            at += 1
            continue
        block = member.block()
        yield at, member.head, block
        at = member.end


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, end: the files cut in ranges, dealt over tasks."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    cut = files.where("size > 0").select("path", starts.alias("start"), "size")
    total = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    return cut.select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end")).repartition(max(1, int(total)), "path", "start")


def number_of(urn: str) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", urn)
    return int(found[1]) if found else None


def records(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of an archive's files; with_payload adds the payload of responses."""

    def read(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(name).to_pylist() for name in ("path", "start", "end"))):
                out = []
                for offset, fields, block in records_in(_Source(path), start, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = int(header_fields(b"\r\n" + http).get("content-length", len(payload)))
                    fine = kind == "revisit" or (size == len(payload) and base32_sha1(payload) == digest)
                    row = (kind, number_of(fields["warc-record-id"]), number_of(fields.get("warc-refers-to", "")), fields.get("warc-target-uri"), digest, size, fine, path, offset)
                    out.append((*row, payload if kind == "response" else None) if with_payload else row)
                    if len(out) >= 500:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    def batch_of(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()][: 10 if with_payload else 9]
        names = [field.split()[0] for field in FIELDS.split(", ")] + ["payload"] * with_payload
        columns = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return ranges(files, range_bytes).mapInArrow(read, FIELDS + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes every page to an archive and reads the archive back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return records(pages.sparkSession, written(pages, folder, least))
