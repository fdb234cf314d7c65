"""The five methods on an authored corpus, and payloads of embedded objects."""

from __future__ import annotations

import io
import struct
import zipfile

from sheafline.operators import evidence, experiments, metrics
from sheafline.sources import embedded

GOLD = "query_id long, query string, namespace string, field_id string, expected_value string, expected_status string, aliases array<string>, field_type string, required boolean, must_have_evidence boolean, gold_ids array<string>, regex string, options array<string>, min double, max double"
CHUNK = "chunk_id long, text string, namespace string, corpus_layer string, source_type string, answer_value string, answer_status string, source_ids array<string>"


def test_methods_improve(spark):
    golds = spark.createDataFrame([
        (1, "rack count", "east", "f1", "12 台", "answered", [], "number", True, True, ["s3"], "", [], 1.0, 100.0),
        (2, "guard on duty", "east", "f2", "是", "answered", [], "bool", True, True, ["s5"], "", [], None, None),
        (3, "unknown thing", "east", "f3", "x", "not_found", [], "text", False, False, [], "", [], None, None),
    ], GOLD)
    chunks = spark.createDataFrame([
        (0, "rack count in general", "global", "fact", "mini_fact", "999 台", "answered", ["s0"]), (1, "guard on duty often", "global", "fact", "mini_fact", "可能", "answered", ["s1"]),
        (2, "rack count here", "east", "fact", evidence.MAIN, "12 台", "answered", ["s3"]), (3, "guard on duty", "east", "fact", evidence.MAIN, "待复核", "answered", ["s4"]),
        (4, "guard on duty table", "east", "fact", evidence.EMBEDDED, "有", "answered", ["s5"]),
    ], CHUNK)
    rows = experiments.compare(golds, chunks)
    summary = {r.method: r for r in metrics.summarize(rows, "method").collect()}
    assert list(summary) and summary[experiments.NAIVE].semantic_match < summary[experiments.FLAT].semantic_match
    assert summary[experiments.NAIVE].evidence_support == 0
    assert summary[experiments.VALIDATED].violation_rate >= summary[experiments.REPAIRED].violation_rate
    got = {(r.method, r.field_id): (r.answer_value, r.answer_status, r.confidence) for r in rows.collect()}
    assert got[experiments.LAYERED, "f2"] == ("待复核", "answered", 0.72) and got[experiments.VALIDATED, "f2"] == ("未找到", "partial_clue", 0.5)
    assert got[experiments.REPAIRED, "f2"] == ("有", "answered", 0.82) and got[experiments.REPAIRED, "f3"] == ("未找到", "not_found", 0.1)
    better = metrics.improvements(rows.where(f"method = '{experiments.LAYERED}'"), rows.where(f"method = '{experiments.REPAIRED}'"))
    assert {r.field_id: r.reasons for r in better.collect()} == {"f2": ["semantic", "valid", "no_review", "no_correction"]}


def compound(name: str, stream: bytes) -> bytes:
    """A compound file of 512-byte sectors with one stream: FAT, directory, then the stream, padded beyond the cutoff."""
    stream = stream + b"\0" * max(0, 4096 - len(stream))
    n = -(-len(stream) // 512)
    header = bytearray(512)
    header[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHHHH", header, 24, 62, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIIIIIIIII", header, 40, 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    struct.pack_into("<109I", header, 76, 0, *[0xFFFFFFFF] * 108)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    entry = lambda name, kind, first, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(stream))).ljust(512, b"\0")
    return bytes(header) + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + directory + stream.ljust(n * 512, b"\0")


def test_embedded_objects(spark):
    pdf = b"%PDF-1.4 data" * 400
    native = struct.pack("<IH", 0, 2) + "报告.pdf".encode("gb18030") + b"\0C:\\x\0" + b"\0\0\3\0" + struct.pack("<I", 2) + b"t\0" + struct.pack("<I", len(pdf)) + pdf
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", "x")
    rows = [("a", "oleObject1.bin", compound("\x01Ole10Native", native)), ("b", None, box.getvalue()), ("c", "x.dwg", b"AC1015"), ("d", None, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 600), ("e", None, None), ("f", "z.bin", b"PK\x03\x04 broken")]
    got = {r.attachment_id: r for r in embedded.objects(spark.createDataFrame(rows, "attachment_id string, name string, content binary")).collect()}
    assert (got["a"].embedded_name, got["a"].file_type, bytes(got["a"].payload)) == ("报告.pdf", "pdf", pdf)
    assert (got["b"].file_type, got["b"].children) == ("docx", ["word/document.xml"]) and got["c"].file_type == "dwg" and got["e"].file_type == "unknown"
    assert got["d"].diagnostics == ["no payload stream"] and got["f"].diagnostics == ["broken archive"]
    assert embedded.repaired_name("报告.pdf".encode("gb18030").decode("cp437")) == "报告.pdf"
