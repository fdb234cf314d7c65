"""Packages made by the tests, read and patched; the vector table; trace streams."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from sheafline.operators import retrieval
from sheafline.sources import files, index, ooxml
from sheafline.streaming import traces

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="B3" s="2"><f>A1+1</f><v>4</v></c><c r="D3" t="b"><v>1</v></c><c r="E3"><f>_xlfn.DISPIMG("x",1)</f><v>p</v></c></row>'
    draw = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Gone" sheetId="2" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {R}><Relationship Id="d" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {draw}><xdr:oneCellAnchor><xdr:from><xdr:col>4</xdr:col><xdr:row>2</xdr:row></xdr:from><xdr:pic><a:blip r:embed="i1"/></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships {R}><Relationship Id="i1" Target="../media/image1.png"/></Relationships>', "xl/media/image1.png": "png",
    })


def document():
    p = lambda t, s="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return package({"word/document.xml": f"<w:document {W}><w:body>{p('Top', 'H1')}{p(' ')}{p('text')}{table}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'})


def table(spark, tmp_path):
    for name, data in (("a.xlsx", workbook()), ("b.docx", document()), ("c.xlsx", b"PK\x03\x04broken"), ("d.xls", bytes.fromhex("D0CF11E0A1B11AE1") + b"x"), ("e.txt", b"t")):
        (tmp_path / name).write_bytes(data)
    return files.registered(files.scan(spark, str(tmp_path)))


def test_probe_and_rows(spark, tmp_path):
    found = table(spark, tmp_path)
    probed = {r.file_name: (r.package_type, r.parse_status, r.media_count) for r in files.probed(found).collect()}
    assert probed == {"a.xlsx": ("xlsx_ooxml", "ok", 1), "b.docx": ("docx_ooxml", "ok", 0), "c.xlsx": ("mixed_or_invalid_ooxml", "needs_conversion", 0), "d.xls": ("ole_compound_document", "needs_conversion", 0), "e.txt": ("unknown", "unsupported", 0)}
    books = found.where("declared_ext = 'xlsx'")
    cells = {r.cell: (r.kind, r.value, r.formula_kind) for r in ooxml.cells(books).collect()}
    assert cells == {"A1": ("shared", "shared", None), "C1": ("inline", "in", None), "B3": ("number", "4", "formula"), "D3": ("bool", "true", None), "E3": ("number", "p", "image")}
    assert [(r.first_row, r.last_row, r.first_col, r.last_col) for r in ooxml.merges(books).collect()] == [(1, 2, 1, 2)]
    assert [(r.row, r.col, r.media_path, r.content_type) for r in ooxml.attachments(books).collect()] == [(3, 5, "xl/media/image1.png", "image/png")]
    blocks = [(r.block_index, r.block_type, r.level, r.row, r.col, r.text) for r in ooxml.blocks(found.where("declared_ext = 'docx'")).collect()]
    assert blocks == [(1, "paragraph", 1, None, None, "Top"), (2, "paragraph", 0, None, None, "text"), (3, "table_cell", 0, 1, 1, "a"), (3, "table_cell", 0, 1, 2, "b")]


def test_patch_round_trip():
    new = ooxml.patch(workbook(), {("One", "B3"): "neu <&>", ("One", "A2"): "row", ("One", "B1"): "mid", ("None", "A1"): "x"})
    rows = {r[5]: r[7] for r in ooxml.workbook_rows("f", new, "cells")}
    assert rows == {"A1": "shared", "B1": "mid", "C1": "in", "A2": "row", "B3": "neu <&>", "D3": "true", "E3": "p"}
    sheet = zipfile.ZipFile(io.BytesIO(new)).read("xl/worksheets/sheet1.xml").decode()
    assert 's="2"' in sheet and list(ooxml.workbook_rows("f", new, "merges")) == [("f", 0, "One", 1, 2, 1, 2)]


def test_vector_table(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text number {i}", "t" if i % 2 else "global", "fact", "s") for i in range(20)], "chunk_id long, text_for_embedding string, namespace string, corpus_layer string, source_type string")
    path = str(tmp_path / "index")
    index.write(index.embedded(chunks, index.HashingEmbedder(64)), path)
    stored = spark.read.parquet(path)
    asked = stored.where("chunk_id = 5").select(F.col("chunk_id").alias("query_id"), "namespace", "vector")
    assert retrieval.vector_topk(asked, stored, retrieval.Plan(least=None)).orderBy("rank").first().chunk_id == 5
    more = chunks.unionByName(chunks.where("chunk_id = 1").withColumn("chunk_id", F.lit(99).cast("long")))
    assert [r.chunk_id for r in index.resume(more, path, spark).collect()] == [99]
    with pytest.raises(Exception, match="vectors"):
        index.embedded(chunks, lambda texts: np.zeros((1, 4))).collect()


def test_streams(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), F.col("user_id").alias("field_id"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for name, run in (("w", traces.windowed), ("s", traces.sessions)):
        q = run(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = {(r.start, r.step): r.n for r in traces.windowed(source).collect()}
    assert {(r.start, r.step): r.n for r in spark.table("q_w").collect()} == want


def test_comments_join_what_a_cell_has():
    notes = {("One", "C1"): "first\nline", ("One", "B3"): "other & <more>"}
    plain = zipfile.ZipFile(io.BytesIO(workbook()))
    types = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
    book = package({n: plain.read(n) for n in plain.namelist()} | {"[Content_Types].xml": types})
    once = ooxml.patch(book, {("One", "C1"): "new"}, notes)
    part = "xl/worksheets/sheet1.xml"
    with zipfile.ZipFile(io.BytesIO(once)) as z:
        assert ooxml.comments(z, part) == {"C1": "first\nline", "B3": "other & <more>"}
        assert z.read(part).count(b"legacyDrawing") == 1 and b"comments+xml" in z.read("[Content_Types].xml") and b'Extension="vml"' in z.read("[Content_Types].xml")
        assert len(z.namelist()) == len(set(z.namelist()))
    twice = ooxml.patch(once, {}, {("One", "C1"): "second", ("One", "D9"): "third"})
    with zipfile.ZipFile(io.BytesIO(twice)) as z:
        assert ooxml.comments(z, part) == {"C1": "first\nline\n\nsecond", "B3": "other & <more>", "D9": "third"}
        shapes = [n for n in z.namelist() if n.endswith(".vml")]
        assert len(shapes) == 1 and z.read(shapes[0]).count(b'ObjectType="Note"') == 3 and z.read(part).count(b"legacyDrawing") == 1
    assert {r[5]: r[7] for r in ooxml.workbook_rows("f", twice, "cells")}["C1"] == "new"


def test_objects_and_images_of_cells():
    x = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    ole = f'<oleObjects {x}><oleObject progId="Word.Document" shapeId="1025" r:id="o1"><objectPr><anchor><from><xdr:col>1</xdr:col><xdr:row>4</xdr:row></from></anchor></objectPr></oleObject><oleObject progId="Word.Document" shapeId="1025" r:id="o1"/><oleObject progId="Package" shapeId="1026" r:id="o2"/></oleObjects>'
    cells = '<row r="3"><c r="E3"><f>_xlfn.DISPIMG("ID_A",1)</f></c><c r="F3"><f>DISPIMG("ID_NONE",1)</f></c></row>'
    book = package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData>{ole}</worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {R}><Relationship Id="o1" Target="../embeddings/a.docx"/><Relationship Id="o2" Target="../embeddings/b.bin"/></Relationships>',
        "xl/cellimages.xml": f'<e:cellImages xmlns:e="urn:x" {x}><e:cellImage><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="1" name="ID_A"/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="m1"/></xdr:blipFill></xdr:pic></e:cellImage></e:cellImages>',
        "xl/_rels/cellimages.xml.rels": f'<Relationships {R}><Relationship Id="m1" Target="media/image9.jpeg"/></Relationships>',
    })
    got = {r[5]: (r[3], r[4], r[6], r[8]) for r in ooxml.workbook_rows("f", book, "attachments")}
    assert got == {"att_f_1025_ole": (5, 2, "xl/embeddings/a.docx", "ole_object"), "att_f_1026_ole": (None, None, "xl/embeddings/b.bin", "ole_object"), "att_f_0_E3_cell": (3, 5, "xl/media/image9.jpeg", "cell_image")}


def test_a_package_that_breaks_midway_gives_no_rows(spark):
    plain = zipfile.ZipFile(io.BytesIO(workbook()))
    parts = {n: plain.read(n) for n in plain.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</sheetData>", b"<broken")
    held = spark.createDataFrame([("bad", bytearray(package(parts))), ("good", bytearray(workbook()))], "file_id string, content binary")
    assert {r.file_id for r in ooxml.cells(held).collect()} == {"good"}
