"""WARC records in ZIP packages: a writer, and a reader that takes records by byte ranges.

A package is a ZIP file whose members are stored, not compressed: archive/data.warc.gz, in which each
record is a gzip member of its own, and indexes/index.jsonl with the archive, offset and length of every
record. The reader needs only seek and read: it parses the end record, the ZIP64 records if there
are any, and the central directory, locates the stored members, lists the indexes and range-reads each record
that the chosen ones name, without unpacking an archive. Every second package of a task has ZIP64 fields
throughout, so that both layouts are read.

Packages are cells (bytes) of a written table, which Spark commits, so a lost executor costs no record and
no reader sees half a file: files that tasks write themselves would have neither. The price is that Spark
reads a whole cell, PACKAGE_BYTES or one record more, before its parts are sought; a package elsewhere, in
anything that seeks, is read by ranges only.

Of the records with equal payloads of at least 1000 bytes the one with the largest page_id is the
response and the others revisit it; rows that share that largest id are all responses, as are all if
no id is known. Null html counts as empty. Repeated rows are written one by one. Empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, skew_join

#: Bytes of payload after which a package is closed.
PACKAGE_BYTES, LEAST_REVISIT = 8 << 20, 1000
_STORED = 0
#: When pages were captured, where nobody knows: the epoch.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


class ZipStore:
    """Writes a ZIP of stored members; ZIP64 fields wherever a size or offset needs them, or always."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.members, self.zip64 = out, [], zip64

    def add(self, name: str, data: bytes) -> None:
        at, raw, crc, n = self.out.tell(), name.encode(), zlib.crc32(data), len(data)
        big = self.zip64 or n >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        short = 0xFFFFFFFF if big else n
        self.out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, _STORED, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra + data)
        self.members.append((raw, crc, n, at))

    def close(self) -> None:
        start = self.out.tell()
        for raw, crc, n, at in self.members:
            wide = [x for x in (n, n, at) if self.zip64 or x >= 0xFFFFFFFF]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            cap = lambda x: 0xFFFFFFFF if self.zip64 or x >= 0xFFFFFFFF else x
            self.out.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0x800, _STORED, 0, 0x21, crc, cap(n), cap(n), len(raw), len(extra), 0, 0, 0, 0, cap(at)) + raw + extra)
        end, count = self.out.tell(), len(self.members)
        if self.zip64 or count >= 0xFFFF or start >= 0xFFFFFFFF or end - start >= 0xFFFFFFFF:
            self.out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, end - start, start) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, end - start, start, 0))


def _at(f: BinaryIO, start: int, n: int) -> bytes:
    f.seek(start)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"the file ends before byte {start + n}")
    return data


def directory(f: BinaryIO) -> dict[str, tuple[int, int]]:
    """Start and size of the data of every stored member, from the central directory."""
    size = f.seek(0, 2)
    tail = _at(f, max(0, size - 65557), min(size, 65557))
    k = tail.rfind(b"PK\5\6")
    if k < 0:
        raise ValueError("no end of central directory")
    end = size - len(tail) + k
    count, length, start = struct.unpack("<10xHII", tail[k : k + 20])
    if end >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        mark, where = struct.unpack("<4s4xQ4x", _at(f, end - 20, 20))
        if mark == b"PK\6\7":
            mark, count, length, start = struct.unpack("<4s28xQQQ", _at(f, where, 56))
            if mark != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
    table, at, members = _at(f, start, length), 0, {}
    for _ in range(count):
        mark, method, size, full, n_name, n_extra, n_note, offset = struct.unpack("<4s6xH8xIIHHH8xI", table[at : at + 46])
        if mark != b"PK\1\2":
            raise ValueError("a broken central directory")
        name, extra = table[at + 46 : at + 46 + n_name].decode(), table[at + 46 + n_name : at + 46 + n_name + n_extra]
        values, k = {"full": full, "size": size, "offset": offset}, 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[k : k + 4])
            if kind == 1:
                j = k + 4
                for field in ("full", "size", "offset"):  # the order that the format fixes
                    if values[field] == 0xFFFFFFFF:
                        values[field] = struct.unpack("<Q", extra[j : j + 8])[0]
                        j += 8
            k += 4 + n
        if method == _STORED:
            own_name, own_extra = struct.unpack("<26xHH", _at(f, values["offset"], 30))
            members[name] = values["offset"] + 30 + own_name + own_extra, values["size"]
        at += 46 + n_name + n_extra + n_note
    return members


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = UNKNOWN_DATE) -> bytes:
    """A WARC/1.1 response, or a revisit if refers_to is known, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header and the payload of a record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    warc = fields(head.decode().split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def package(records: list[tuple[object, bytes]], zip64: bool = False, name: str = "data.warc.gz") -> bytes:
    out, at, index = io.BytesIO(), 0, []
    for page_id, data in records:
        index.append(json.dumps({"page_id": page_id, "filename": name, "offset": at, "length": len(data)}))
        at += len(data)
    zip_file = ZipStore(out, zip64)
    zip_file.add(f"archive/{name}", b"".join(d for _, d in records))
    zip_file.add("indexes/index.jsonl", "\n".join(index).encode())
    zip_file.close()
    return out.getvalue()


def read_package(f: BinaryIO, indexes: list[str] | None = None) -> Iterator[tuple[object, dict[str, str], dict[str, str], bytes]]:
    """page_id, headers and payload of every record that the package's indexes (all of them, or the named members) tell of."""
    members = directory(f)
    for name in sorted(m for m in members if m.startswith("indexes/")) if indexes is None else indexes:
        lines = _at(f, *members[name]).decode()
        for line in lines.split("\n") if lines else []:
            entry = json.loads(line)
            start, size = members[f"archive/{entry['filename']}"]
            if entry["offset"] + entry["length"] > size:
                raise ValueError("a record beyond its archive")
            yield entry["page_id"], *parse(_at(f, start + entry["offset"], entry["length"]))


def write_packages(pages: DataFrame) -> DataFrame:
    """Packages (bytes) of a WARC record for each row (page_id, url, html, payload_digest, refers_to)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, wide = [], 0, False
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                payload = (html.as_py() or "").encode()
                records.append((page_id.as_py(), record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py())))
                size += len(payload)
                if size >= PACKAGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([package(records, wide)], pa.binary())], names=["package"])
                    records, size, wide = [], 0, not wide
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([package(records, wide)], pa.binary())], names=["package"])

    return cut(pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "package binary"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests of responses are recomputed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for page_id, warc, http, payload in read_package(pa.BufferReader(value.as_buffer())):
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of page {page_id} does not match its digest")
                    rows.append((page_id, int(http["content-length"]), digest, kind, int(warc["warc-refers-to"][10:-1]) if kind == "revisit" else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return packages.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """What reading the archives of pages (page_id, url, html) gives back."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    narrow = cut(rows.select("page_id", "payload_digest", F.octet_length("html").alias("n")), "digests")
    # few payloads occur twice: only they enter the join
    twice = narrow.where(F.col("n") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 and response is not null")
    revisits = cut(skew_join(narrow.where(F.col("n") >= LEAST_REVISIT), twice, "payload_digest", "copies", narrow.count()).where("page_id is null or page_id <> response").select("page_id", "payload_digest", "response").distinct(), "revisits")
    joined = revisits.withColumnsRenamed({"page_id": "id", "payload_digest": "d", "response": "refers_to"})
    same = (F.col("payload_digest") == F.col("d")) & F.coalesce("page_id", F.lit(-1)).eqNullSafe(F.coalesce("id", F.lit(-1))) & F.col("page_id").isNull().eqNullSafe(F.col("id").isNull())
    return read_packages(write_packages(rows.join(joined, same, "left")))
