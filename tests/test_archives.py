"""Archives inside documents inside archives: every object with its lineage, bounds, and what can't be opened."""

from __future__ import annotations

import hashlib
import io
import zipfile

from sheafline.sources import archives
from test_sources import document, package, workbook

SCHEMA = "attachment_id string, name string, content binary"


def objects(spark, rows, limits=archives.Limits()):
    return archives.expanded(spark.createDataFrame([(i, n, None if c is None else bytearray(c)) for i, n, c in rows], SCHEMA), limits)


def told(frame):
    return {r.object_id: (r.parent_id, list(r.path), r.depth, r.file_type, r.status, r.n_members) for r in frame.collect()}


def with_parts(data, parts):
    old = zipfile.ZipFile(io.BytesIO(data))
    return package({n: old.read(n) for n in old.namelist()} | parts)


def test_a_workbook_in_a_zip_in_a_document(spark):
    inner = package({"deep/book.xlsx": workbook(), "note.txt": b"plain"})
    outer = with_parts(document(), {"word/embeddings/pack.zip": inner, "word/media/image1.png": b"\x89PNG\r\n\x1a\n"})
    found = objects(spark, [("a", "top.docx", outer), ("b", "empty", None)])
    assert told(found) == {
        "a": (None, [], 0, "docx", "document", 1),
        "a/1": ("a", ["word/embeddings/pack.zip"], 1, "zip", "parsed_archive", 2),
        "a/1/1": ("a/1", ["word/embeddings/pack.zip", "deep/book.xlsx"], 2, "xlsx", "document", 0),
        "a/1/2": ("a/1", ["word/embeddings/pack.zip", "note.txt"], 2, "unknown", "leaf", 0),
        "b": (None, [], 0, "unknown", "leaf", 0),
    }
    said = archives.nested_segments(found)
    rows = {(r.object_id, r.block_type, r.ordinal): (r.lineage, r.text) for r in said.collect()}
    assert rows["a/1/1", "sheet_row", 1] == ("word/embeddings/pack.zip > deep/book.xlsx", "shared | in")
    assert {k[0] for k in rows} == {"a", "a/1/1"}
    assert archives.unread(found, said).count() == 0
    summary = {r.root_id: (r.n_objects, r.depth, r.statuses) for r in archives.archive_summary(found).collect()}
    assert summary == {"a": (4, 2, {"document": 2, "leaf": 1, "parsed_archive": 1}), "b": (1, 0, {"leaf": 1})}


def test_no_list_is_cut(spark):
    many = package({f"m{i:04}.txt": str(i) for i in range(700)})
    found = objects(spark, [("z", "many.zip", many)])
    assert found.count() == 701
    row = found.where("name = 'm0699.txt'").first()
    assert (row.object_id, bytes(row.content), row.digest) == ("z/700", b"699", hashlib.sha256(b"699").hexdigest())


def test_leaves_take_no_round_and_bytes_are_kept_on_demand(spark, monkeypatch):
    inner = package({f"{i}.txt": f"text {i}" * 100 for i in range(5)} | {"p.png": b"\x89PNG\r\n\x1a\n" + b"x" * 90, "r.rar": b"Rar!\x1a\x07\x00rest"})
    rows = spark.createDataFrame([("z", "z.zip", bytearray(package({"in.zip": inner, "top.txt": b"top"})))], SCHEMA)
    opened, whole = [], archives._round
    monkeypatch.setattr(archives, "_round", lambda frontier, *rest: opened.append(frontier.count()) or whole(frontier, *rest))
    full = archives.expanded(rows)
    assert opened == [1, 1]
    assert bytes(full.where("object_id = 'z/1/1'").first().content) == b"text 0" * 100
    bare = archives.expanded(rows, contents=False)
    assert bare.where("content is not null").count() == 0
    drop = lambda f: sorted(map(str, f.drop("content").collect()))
    assert drop(bare) == drop(full) and {r.file_type for r in bare.collect()} == {"zip", "unknown", "image", "rar"}
    monkeypatch.setattr(archives, "ROOTS", 0)
    assert drop(archives.expanded(rows)) == drop(full)


def squeezed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_bombs_yield_a_status(spark):
    bomb = squeezed({f"{i}.bin": b"\0" * 200_000 for i in range(10)})
    nested = squeezed({f"{i}.zip": bomb for i in range(20)})
    limits = archives.Limits(root_bytes=1_000_000)
    found = objects(spark, [("flat", "a.zip", bomb), ("deep", "b.zip", nested), ("fine", "c.zip", squeezed({"t": b"text"}))], limits)
    states = {}
    for r in found.collect():
        states.setdefault(r.root_id, []).append((r.status, r.size, r.content is None, r.depth))
    assert sorted(s for s, *_ in states["flat"]) == ["leaf"] * 5 + ["over_budget"] * 5 + ["parsed_archive"]
    for root in ("flat", "deep"):
        assert sum(size for s, size, none, depth in states[root] if depth and not none) <= limits.root_bytes
    assert {s for s, *_ in states["deep"]} >= {"over_budget"} and len(states["fine"]) == 2
    declared = bytearray(squeezed({"x": b"\0" * 300_000}))
    at = declared.rfind(b"PK\x01\x02")
    declared[at + 24 : at + 28] = (10).to_bytes(4, "little")  # declares 10 bytes
    got = {r.object_id: r.status for r in objects(spark, [("lie", "x.zip", bytes(declared))], limits).collect()}
    assert got["lie"] == "parsed_archive" and got["lie/1"].startswith("broken_member")


def test_depth_and_recursion(spark):
    data = b"core"
    for _ in range(5):
        data = package({"in.zip": data})
    found = told(objects(spark, [("d", "d.zip", data)], archives.Limits(depth=3)))
    assert [(k, v[4], v[5]) for k, v in sorted(found.items())] == [("d", "parsed_archive", 1), ("d/1", "parsed_archive", 1), ("d/1/1", "parsed_archive", 1), ("d/1/1/1", "too_deep", 1)]
    assert told(objects(spark, [("d", "d.zip", data)], archives.Limits(members=0)))["d"][4] == "too_many_members"


def test_what_cannot_be_opened(spark):
    locked = bytearray(package({"secret.txt": b"x"}))
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):
        at = locked.find(mark)
        locked[at + (6 if mark[2] == 3 else 8)] |= 1
    broken = bytearray(squeezed({"a.txt": b"some text that is squeezed" * 50, "b.txt": b"fine"}))
    broken[45:60] = b"\xff" * 15
    rows = [("locked", "l.zip", bytes(locked)), ("cut", "c.zip", package({"a": b"x"})[:40]), ("rar", "r.rar", b"Rar!\x1a\x07\x00rest"), ("member", "m.zip", bytes(broken)), ("ole", "o.bin", bytes.fromhex("D0CF11E0A1B11AE1") + b"short")]
    found = objects(spark, rows)
    states = {r.object_id: r.status for r in found.collect()}
    assert states["locked/1"] == "encrypted" and states["rar"] == "unsupported_archive" and states["cut"].startswith("broken_archive")
    assert states["member/1"].startswith("broken_member") and states["member/2"] == "leaf" and states["ole"].startswith("broken_compound")
    reasons = {r.object_id for r in archives.unread(found, archives.nested_segments(found)).collect()}
    assert reasons == {"locked/1", "rar", "cut", "member/1", "ole"}


def test_a_broken_document_is_named(spark):
    bad = package({"word/document.xml": "<w:document", "x": "y"})
    found = objects(spark, [("z", "z.zip", package({"bad.docx": bad}))])
    assert [(r.object_id, r.reason) for r in archives.unread(found, archives.nested_segments(found)).collect()] == [("z/1", "no_segments")]


def test_packed_comes_back(spark):
    rows = spark.createDataFrame([("p.zip", f"{i:03}.txt", bytearray(str(i), "ascii")) for i in range(30)] + [("q.zip", "only", None)], "name string, member string, content binary")
    found = archives.expanded(archives.packed(rows).selectExpr("name attachment_id", "name", "content"))
    assert [bytes(r.content) for r in found.where("root_id = 'p.zip' and depth = 1").orderBy("ordinal").collect()] == [str(i).encode() for i in range(30)]
    assert found.where("root_id = 'q.zip' and depth = 1").first().size == 0


def test_no_attachments(spark):
    assert objects(spark, []).count() == 0
