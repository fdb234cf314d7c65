"""WARC records in ZIP-packaged archives, written and read by range.

A package is a ZIP of stored members: ``archive/*.warc.gz`` with one gzip member for each record, and
``indexes/*.cdxj`` with one line for each record: its target, offset and length in the archive. As members are
stored, a record is a range of the package's own bytes: the reader parses the central directory (ZIP64 included),
finds members and index, and reads and unpacks single records. Nothing is extracted.

Packages are written by the tasks that hold the records, each to a name of its own attempt in a folder that driver
and executors share; only packages of attempts that ended are in the stored list that the reader works from.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

#: A package is closed when its archive has so many bytes.
PACKAGE_BYTES = 64_000_000
#: Index lines a reading task gets at once.
LINES = 2_000
#: Repeated payloads whose digests are broadcast, at most: about 30 MB. Beyond, records are joined by a shuffle.
REPEATED = 200_000
EOCD, EOCD64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(target: str, record_id: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record as one gzip member: a response, or a revisit that holds headers only.

    The HTTP headers keep the payload's full length, so that a revisit tells it too.
    """
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": target, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest32(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, body) of a record's gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


class ZipWriter:
    """A ZIP of stored members, written front to back; ZIP64 where a number needs it, or always with ``wide``."""

    def __init__(self, out, wide: bool = False):
        self.out, self.at, self.entries, self.wide = out, 0, [], wide

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, size, raw, wide = zlib.crc32(data), len(data), name.encode(), self.wide or len(data) >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        start = self.at
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, *([MAX32] * 2 if wide else [size] * 2), len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            wide = self.wide or max(size, offset) >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            numbers = [MAX32] * 2 if wide else [size] * 2
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, *numbers, len(raw), len(extra), 0, 0, 0, 0, MAX32 if wide else offset) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.wide or start >= MAX32 or n >= MAX16:
            end = self.at
            self._put(EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(EOCD + struct.pack("<HHHHIIH", 0, 0, min(n, MAX16), min(n, MAX16), min(size, MAX32), MAX32 if self.wide else min(start, MAX32), 0))


def _at(file, start: int, n: int) -> bytes:
    file.seek(start)
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the package ends early")
    return data


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the bytes of each stored member, from the central directory. Ranges are read, members aren't."""
    tail_at = max(0, size - MAX16 - 42)
    tail = _at(file, tail_at, size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == LOCATOR and (n == MAX16 or MAX32 in (length, start)):
        end = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, out, at = _at(file, start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, name_n, extra_n, note_n, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)[0:7]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: those of the numbers that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(wide) if plain == MAX32 else plain
                packed = next(wide) if packed == MAX32 else packed
                offset = next(wide) if offset == MAX32 else offset
            extra = extra[4 + width :]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = _at(file, offset, 30)
        out[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), plain)
        at += 46 + name_n + extra_n + note_n
    return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; s3a and s3n are other names of s3."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://").replace("s3n://", "s3://"))


def _write_batches(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, lines, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            where, at = _open(f"{folder}/{uuid.uuid4().hex}.wacz")
            where.create_dir(at.rpartition("/")[0], recursive=True)
            with where.open_output_stream(at) as out:
                package = ZipWriter(out)
                package.add("archive/data.warc.gz", archive.getvalue())
                package.add("indexes/index.cdxj", "".join(lines).encode())
                package.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at.rpartition('/')[2]}"]), pa.array([n], pa.int64())], ["path", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                kept = r["refers_to"]
                start = archive.tell()
                archive.write(record(f"urn:page:{r['page_id']}", f"urn:record:{r['page_id']}", payload, None if kept is None else f"urn:record:{kept}"))
                lines.append(f"{r['page_id']} {json.dumps({'filename': 'data.warc.gz', 'offset': start, 'length': archive.tell() - start})}\n")
                n += 1
                if archive.tell() >= most:
                    yield close()
                    archive, lines, n = io.BytesIO(), [], 0
        if n:
            yield close()

    return run


def plan_records(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``page_id, html, refers_to``: of pages with equal payloads of ``smallest`` bytes or more, all but the smallest page_id refer to it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= smallest
    # only payloads that repeat; counted before they are shuffled
    repeated = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    repeated = materialise(repeated)
    joined = rows.join(F.broadcast(repeated) if repeated.count() <= REPEATED else repeated, "digest", "left")
    return joined.select("page_id", "html", F.when(F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(None)).otherwise(F.col("first_id")).alias("refers_to"))


def write_packages(records: DataFrame, most: int = PACKAGE_BYTES) -> DataFrame:
    """Writes ``records(page_id, html, refers_to)`` and returns the stored list ``path, n`` of packages."""
    return materialise(records.select("page_id", "html", "refers_to").mapInArrow(_write_batches(scratch(records.sparkSession), most), "path string, n long"))


def _lines_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                where, at = _open(path)
                with where.open_input_file(at) as file:
                    held = members(file, file.size())
                    for name in sorted(x for x in held if x.startswith("indexes/")):
                        lines = _at(file, *held[name]).decode().splitlines()
                        for i in range(0, len(lines), most):
                            found = [json.loads(x.split(" ", 1)[1]) for x in lines[i : i + most]]
                            starts = [held["archive/" + x["filename"]][0] + x["offset"] for x in found]
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([starts], pa.list_(pa.int64())), pa.array([[x["length"] for x in found]], pa.list_(pa.int64()))], ["path", "starts", "lengths"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return None if tail in ("", "None") else int(tail)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            where, at = _open(row["path"])
            out = []
            with where.open_input_file(at) as file:
                for start, length in zip(row["starts"], row["lengths"], strict=True):
                    fields, http, body = parse(_at(file, start, length))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (digest32(body) != digest or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"the record at {start} of {row['path']} is damaged")
                    out.append((_number(fields["WARC-Target-URI"]), int(http["Content-Length"]), digest, fields["WARC-Type"], _number(fields.get("WARC-Refers-To"))))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_packages(packages: DataFrame, lines: int = LINES) -> DataFrame:
    """Every record of ``packages(path, n)``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Indexes are read first; then ranges of records are dealt out, so that a large package is read by many tasks. The
    numbers of tasks come from the stored list, as a path or a range is few bytes with much work behind it.
    """
    files, ranges = packages.agg(F.count("*"), F.sum(F.ceil(F.col("n") / lines))).first()
    found = packages.select("path").repartition(max(1, files)).mapInArrow(_lines_batches(lines), "path string, starts array<long>, lengths array<long>")
    return found.repartition(max(1, ranges or 0)).mapInArrow(_read_batches, READ)


def archive_pages(pages: DataFrame, smallest: int = 0, most: int = PACKAGE_BYTES, lines: int = LINES) -> DataFrame:
    """Writes a record for every row of ``pages(page_id, html)`` into packages and reads them back.

    A null html is an empty payload. Payloads are equal if their bytes are (by SHA-1); the smallest page_id of
    equal payloads of ``smallest`` bytes or more is the response, others revisit it; smaller payloads are all
    responses. Rows that repeat the smallest page_id are responses each; rows without page_id revisit a page
    that has one, or are responses. Other columns are ignored; an empty table gives an empty table.
    """
    return read_packages(write_packages(plan_records(pages, smallest), most), lines)
