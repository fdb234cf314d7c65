"""Objects inside documents: file types by content and name, payloads of OLE containers, children of archives."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.order import first_match

#: Fixed values: (type, first bytes as hex, pattern of the name); the first that fits decides.
TYPES = (("pdf", "255044462D", r"\.pdf$"), ("rar", "526172211A07", r"\.rar$"), ("dwg", "41433130", r"\.dwg$"), ("image", "89504E470D0A1A0A", r"\.png$"), ("image", "FFD8FF", r"\.jpe?g$"), ("doc", None, r"\.doc$"), ("docx", None, r"\.docx$"), ("xlsx", None, r"\.xlsx$"), ("pptx", None, r"\.pptx$"))
#: Sectors of compound files that end a chain or are free.
END_OF_CHAIN = 0xFFFFFFFA
#: Children of an archive that are listed with a record.
CHILDREN = 50


def file_type(content: Column, name: Column, parts: Column) -> Column:
    """What a payload is: by its first bytes or its name, packages by their parts. ``parts``: names in a ZIP, null for none."""
    head, lower = F.hex(F.substring(content, 1, 8)), F.lower(F.coalesce(name, F.lit("")))
    plain = [((F.startswith(head, F.lit(magic)) if magic else F.lit(False)) | lower.rlike(pattern), kind) for kind, magic, pattern in TYPES]
    has = lambda p: F.exists(parts, lambda n: n.rlike(p))
    zipped = [(parts.isNotNull() & has(p), kind) for p, kind in ((r"^word/document\.xml$", "docx"), (r"^xl/workbook\.xml$", "xlsx"), (r"^ppt/presentation\.xml$", "pptx"), (r"^visio/", "vsdx"))]
    return first_match([*plain, *zipped, (parts.isNotNull(), "zip"), (lower.rlike(r"\.vsdx$"), "vsdx")], "unknown")


def ole_stream(data: bytes, wanted: str) -> bytes | None:
    """The bytes of the first stream of this name in a compound file; None if there is none or the file is broken."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        return None
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    n_fat, start, cutoff, small_start = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    size = 1 << shift
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    fat = [x for k in struct.unpack_from("<109I", data, 76)[:n_fat] if k < END_OF_CHAIN for x in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(first: int, table, read) -> bytes:
        out, seen = [], set()
        while first < END_OF_CHAIN and first < len(table) and first not in seen:
            seen.add(first)
            out.append(read(first))
            first = table[first]
        return b"".join(out)

    directory = chain(start, fat, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        width = struct.unpack_from("<H", directory, at + 64)[0]
        first, length = struct.unpack_from("<II", directory, at + 116)
        entries.append((directory[at : at + max(0, width - 2)].decode("utf-16-le", "replace"), directory[at + 66], first, length))
    if not entries:
        return None
    small = chain(entries[0][2], fat, sector)
    raw = chain(small_start, fat, sector)
    small_fat = struct.unpack(f"<{len(raw) // 4}I", raw)
    piece = 1 << small_shift
    for name, kind, first, length in entries:
        if kind == 2 and name == wanted:
            return chain(first, small_fat, lambda k: small[k * piece : (k + 1) * piece])[:length] if length < cutoff else chain(first, fat, sector)[:length]
    return None


def native_payload(stream: bytes) -> tuple[str, bytes]:
    """(file name, bytes) of an ``Ole10Native`` stream: size, flags, label, source path, reserved, temporary path, size, payload."""
    at = 6
    texts = []
    for _ in range(2):
        end = stream.find(b"\0", at)
        end = len(stream) if end < 0 else end
        texts.append(stream[at:end])
        at = end + 1
    at += 4
    (skip,) = struct.unpack_from("<I", stream, at) if len(stream) >= at + 4 else (0,)
    at += 4 + (skip if skip <= 4096 else 0)
    (size,) = struct.unpack_from("<I", stream, at) if len(stream) >= at + 4 else (0,)
    at += 4
    size = size if 0 < size <= len(stream) - at else max(0, len(stream) - at)
    return decoded(texts[0]), stream[at : at + size]


def decoded(raw: bytes) -> str:
    for coding in ("utf-8", "gb18030"):
        try:
            return raw.decode(coding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def repaired_name(name: str) -> str:
    """A ZIP member's name as GB18030 instead of cp437, if it then has more CJK characters."""
    cjk = lambda s: sum("一" <= c <= "鿿" for c in s)
    try:
        other = name.encode("cp437").decode("gb18030")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return name
    return other if cjk(other) > cjk(name) else name


OBJECTS = "attachment_id string, embedded_name string, payload binary, parts array<string>, diagnostics array<string>"


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, name, data in zip(batch["attachment_id"].to_pylist(), batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
            notes, parts = [], None
            data = data or b""
            stream = ole_stream(data, "\x01Ole10Native") if data[:4] == b"\xd0\xcf\x11\xe0" else None
            if stream is not None:
                name, data = native_payload(stream)
            elif data[:4] == b"\xd0\xcf\x11\xe0":
                inner = ole_stream(data, "Package") or ole_stream(data, "CONTENTS")
                data, notes = (inner, notes) if inner else (data, ["no payload stream"])
            try:
                parts = [repaired_name(x) for x in zipfile.ZipFile(io.BytesIO(data)).namelist()] if data[:4] == b"PK\x03\x04" else None
            except zipfile.BadZipFile:
                notes = [*notes, "broken archive"]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([name], pa.string()), pa.array([data], pa.binary()), pa.array([parts], pa.list_(pa.string())), pa.array([notes], pa.list_(pa.string()))], ["attachment_id", "embedded_name", "payload", "parts", "diagnostics"])


def objects(attachments: DataFrame) -> DataFrame:
    """Payloads of ``attachments(attachment_id, name, content)``: embedded_name, file_type, size, payload, children (50 listed), n_children, diagnostics."""
    found = attachments.select("attachment_id", "name", "content").mapInArrow(_payloads, OBJECTS)
    kind = file_type(F.col("payload"), F.col("embedded_name"), F.col("parts"))
    children = F.coalesce("parts", F.array().cast("array<string>"))
    return found.select("attachment_id", "embedded_name", kind.alias("file_type"), F.octet_length("payload").alias("size"), "payload", F.slice(children, 1, CHILDREN).alias("children"), F.size(children).alias("n_children"), "diagnostics")
