"""Workbooks and documents as rows: cells, merges, attachments, blocks and table cells.

Packages are read where their bytes are, one file at a time, and rows are yielded in batches, so memory holds one
package part. What is done with the rows afterwards (header rows, merged values, segments) is DataFrame work.
"""

from __future__ import annotations

import io
import mimetypes
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

#: XML namespaces of the formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"

CELLS = "file_id string, sheet_index int, sheet_name string, row int, col int, cell string, kind string, value string, formula string, formula_kind string, style int"
MERGES = "file_id string, sheet_index int, sheet_name string, first_row int, last_row int, first_col int, last_col int"
ATTACHMENTS = "file_id string, sheet_index int, sheet_name string, row int, col int, attachment_id string, media_path string, content_type string, anchor_type string, preview_path string"
LAYOUT = "file_id string, sheet_index int, sheet_name string, kind string, first int, last int, ref string"
BLOCKS = "file_id string, block_index long, block_type string, style string, level int, table_index int, row int, col int, text string"
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "emf": "image/x-emf", "wmf": "image/x-wmf", "tif": "image/tiff", "tiff": "image/tiff"}
HIDDEN = ("1", "true")
IMAGE_CALL = re.compile(r'DISPIMG\("([^"]+)"', re.IGNORECASE)
SHAPE_ID = re.compile(r"_x0000_s(\d+)")
REF = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")


def place(ref: str) -> tuple[int, int]:
    """(row, col) of an A1 address."""
    letters, digits = REF.fullmatch(ref.upper()).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def relations(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in package.namelist():
        return {}
    base = posixpath.dirname(part)
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(base, t))
    return {r.get("Id"): target(r.get("Target", "")) for r in ET.fromstring(package.read(name)).iter(f"{PACKAGE}Relationship")}


def listed_sheets(package: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """(index, name, part) of the sheets that a workbook lists, in its order, whether the part is there or not."""
    known = relations(package, "xl/workbook.xml")
    for i, s in enumerate(ET.fromstring(package.read("xl/workbook.xml")).iter(f"{MAIN}sheet")):
        yield i, s.get("name", ""), known.get(s.get(f"{REL}id"), "")


def sheets(package: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """The listed sheets whose part is there."""
    held = set(package.namelist())
    return (s for s in listed_sheets(package) if s[2] in held)


def layout_rows(file_id: str, data: bytes) -> Iterator[tuple]:
    """What a workbook says of its sheets besides cells, as ranges: ``sheet`` (ref: its part), ``missing`` (a sheet without its part), ``dimension`` (ref: as declared), ``hidden_rows``, ``hidden_cols``."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        held = set(package.namelist())
        for i, name, part in listed_sheets(package):
            yield file_id, i, name, "sheet" if part in held else "missing", None, None, part
            if part not in held:
                continue
            first = last = None
            with package.open(part) as stream:
                for _, e in ET.iterparse(stream):
                    if e.tag == f"{MAIN}dimension":
                        yield file_id, i, name, "dimension", None, None, e.get("ref")
                    elif e.tag == f"{MAIN}col" and e.get("hidden") in HIDDEN:
                        yield file_id, i, name, "hidden_cols", int(float(e.get("min", "0"))), int(float(e.get("max", "0"))), None
                    elif e.tag == f"{MAIN}row":
                        at = int(e.get("r", "0"))
                        if e.get("hidden") in HIDDEN and at:
                            if last != at - 1:  # hidden rows that follow one another are one range
                                if first:
                                    yield file_id, i, name, "hidden_rows", first, last, None
                                first = at
                            last = at
                        e.clear()
            if first:
                yield file_id, i, name, "hidden_rows", first, last, None


def shared_strings(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(package.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def cell_value(c: ET.Element, strings: list[str]) -> tuple[str, str | None, str | None, str | None]:
    """(kind, value, formula, formula kind) of a cell; a formula keeps its cached value."""
    kind, v, f = c.get("t", "n"), c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
    text = v.text if v is not None else None
    if kind == "s":
        text = strings[int(text)] if text is not None and text.isdigit() and int(text) < len(strings) else None
    elif kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
    elif kind == "b":
        text = {"1": "true", "0": "false"}.get(text or "", text)
    formula = f.text or "" if f is not None else None
    image = formula is not None and "DISPIMG" in formula.upper()
    return {"s": "shared", "inlineStr": "inline", "str": "string", "b": "bool", "e": "error"}.get(kind, "number"), text, formula, None if formula is None else "image" if image else "formula"


def workbook_rows(file_id: str, data: bytes, what: str) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        strings = shared_strings(package) if what == "cells" else []
        for i, name, part in sheets(package):
            if what == "attachments":
                yield from anchored(package, file_id, i, name, part)
                continue
            with package.open(part) as stream:
                for _, e in ET.iterparse(stream):
                    if what == "cells" and e.tag == f"{MAIN}c" and e.get("r"):
                        kind, value, formula, formula_kind = cell_value(e, strings)
                        if value is not None or formula is not None:
                            row, col = place(e.get("r"))
                            yield file_id, i, name, row, col, e.get("r"), kind, value, formula, formula_kind, int(e.get("s")) if (e.get("s") or "").isdigit() else None
                    elif what == "merges" and e.tag == f"{MAIN}mergeCell":
                        first, _, last = e.get("ref", "").partition(":")
                        (r1, c1), (r2, c2) = place(first), place(last or first)
                        yield file_id, i, name, r1, r2, c1, c2
                    if e.tag == f"{MAIN}row":
                        e.clear()


def cell_images(package: zipfile.ZipFile) -> dict[str, str]:
    """Media of the images that formulas put in cells, by the name that the formula gives."""
    part = "xl/cellimages.xml"
    if part not in package.namelist():
        return {}
    media, found = relations(package, part), {}
    for image in ET.fromstring(package.read(part)):
        named, blip = next(image.iter(f"{DRAW}cNvPr"), None), next(image.iter(BLIP), None)
        if named is not None and blip is not None:
            found[named.get("name", "")] = media.get(blip.get(f"{REL}embed") or "", "")
    return found


def legacy_shapes(package: zipfile.ZipFile, part: str) -> dict[str, tuple[tuple[int, int] | None, str | None]]:
    """Cell and preview image of the shapes in a sheet's legacy drawings, by shape id.

    An anchor is eight numbers, of which the first is the left column and the third the top row, both from 0. A drawing
    that can't be read has no shapes; a shape without an anchor, or with one that isn't numbers, has no cell.
    """
    found, held = {}, set(package.namelist())
    for drawing in (p for p in relations(package, part).values() if p.endswith(".vml") and p in held):
        media = relations(package, drawing)
        try:
            root = ET.fromstring(package.read(drawing))
        except ET.ParseError:
            continue
        for shape in (e for e in root.iter() if e.tag.rpartition("}")[2] == "shape"):
            named = {k.rpartition("}")[2].lower(): v for k, v in shape.attrib.items()}
            number = SHAPE_ID.search(named.get("spid") or "") or SHAPE_ID.search(named.get("id") or "")
            if number is None:
                continue
            parts = {e.tag.rpartition("}")[2].lower(): e for e in shape.iter()}
            cell = preview = None
            if "anchor" in parts:
                numbers = [x.strip() for x in (parts["anchor"].text or "").split(",")]
                if len(numbers) >= 3 and all(re.fullmatch(r"-?\d+", x) for x in numbers):
                    cell = int(numbers[2]) + 1, int(numbers[0]) + 1
            if "imagedata" in parts:
                ids = {k.rpartition("}")[2].lower(): v for k, v in parts["imagedata"].attrib.items()}
                preview = media.get(ids.get("relid") or "")
            found[number.group(1)] = cell, preview
    return found


def objects_of(package: zipfile.ZipFile, part: str) -> Iterator[tuple[str, str, str | None, tuple[int, int] | None, str | None]]:
    """(shape id, object's part, program, cell, preview) of the objects that a sheet embeds, each once.

    The cell is the one that the sheet itself names, else that of the object's shape in a legacy drawing, else null.
    """
    targets, seen = relations(package, part), set()
    shapes = legacy_shapes(package, part)
    with package.open(part) as stream:
        for _, e in ET.iterparse(stream):
            if e.tag != f"{MAIN}oleObject":
                continue
            shape, target = e.get("shapeId") or e.get(f"{REL}id") or "", targets.get(e.get(f"{REL}id") or "", "")
            if not target or (shape, target) in seen:
                continue
            seen.add((shape, target))
            at = next(e.iter(f"{MAIN}from"), None)
            cell = None if at is None else (int(at.findtext(f"{DRAW}row", "0")) + 1, int(at.findtext(f"{DRAW}col", "0")) + 1)
            drawn, preview = shapes.get(shape, (None, None))
            yield shape, target, e.get("progId"), cell or drawn, preview


def anchored(package: zipfile.ZipFile, file_id: str, index: int, name: str, part: str) -> Iterator[tuple]:
    """Images of a sheet's drawings with the cell their upper left corner is in, embedded objects, and images of formulas.

    The corrected attribute ``r:embed`` is read first, then ``r:id``.
    """
    drawings = [p for p in relations(package, part).values() if "/drawings/" in p and p.endswith(".xml") and p in package.namelist()]
    for drawing in drawings:
        media = relations(package, drawing)
        for k, anchor in enumerate(ET.fromstring(package.read(drawing))):
            at, blip = anchor.find(f"{DRAW}from"), next(anchor.iter(BLIP), None)
            if at is None or blip is None:
                continue
            path = media.get(blip.get(f"{REL}embed") or blip.get(f"{REL}id") or "", "")
            row, col = int(at.findtext(f"{DRAW}row", "0")) + 1, int(at.findtext(f"{DRAW}col", "0")) + 1
            kind = MEDIA_TYPES.get(path.rpartition(".")[2].lower(), "application/octet-stream")
            yield file_id, index, name, row, col, f"att_{file_id}_{index}_{posixpath.basename(drawing)}_{k}", path, kind, "drawing", None
    for shape, path, _, cell, preview in objects_of(package, part):
        kind = mimetypes.guess_type(path)[0] or "application/vnd.openxmlformats-officedocument.oleObject"
        yield file_id, index, name, *(cell or (None, None)), f"att_{file_id}_{shape}_ole", path, kind, "ole_object", preview
    images = cell_images(package)
    if images:
        with package.open(part) as stream:
            for _, e in ET.iterparse(stream):
                if e.tag == f"{MAIN}c" and e.get("r") and (call := IMAGE_CALL.search(e.findtext(f"{MAIN}f") or "")) and call.group(1) in images:
                    row, col = place(e.get("r"))
                    path = images[call.group(1)]
                    yield file_id, index, name, row, col, f"att_{file_id}_{index}_{e.get('r')}_cell", path, MEDIA_TYPES.get(path.rpartition(".")[2].lower(), "application/octet-stream"), "cell_image", None


def heading_level(style: str | None) -> int:
    """1 to 9 for heading styles, else 0."""
    found = re.search(r"(?:heading|标题)\s*(\d)", style or "", re.IGNORECASE)
    return int(found.group(1)) if found else 0


def document_rows(file_id: str, data: bytes) -> Iterator[tuple]:
    """Paragraphs that aren't blank, in order, and the cells of tables, each table with the index of its place."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        names = {}
        if "word/styles.xml" in package.namelist():
            for s in ET.fromstring(package.read("word/styles.xml")).iter(f"{WORD}style"):
                label = s.find(f"{WORD}name")
                names[s.get(f"{WORD}styleId")] = label.get(f"{WORD}val") if label is not None else None
        body = ET.fromstring(package.read("word/document.xml")).find(f"{WORD}body")
        index = tables = 0
        for e in body if body is not None else ():
            if e.tag == f"{WORD}p":
                text = "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
                if text:
                    index += 1
                    ref = e.find(f"{WORD}pPr/{WORD}pStyle")
                    style = None if ref is None else names.get(ref.get(f"{WORD}val"), ref.get(f"{WORD}val"))
                    yield file_id, index, "paragraph", style, heading_level(style), None, None, None, text
            elif e.tag == f"{WORD}tbl":
                tables, index = tables + 1, index + 1
                for r, line in enumerate(e.iter(f"{WORD}tr"), 1):
                    for c, cell in enumerate(line.findall(f"{WORD}tc"), 1):
                        yield file_id, index, "table_cell", None, 0, tables, r, c, "".join(t.text or "" for t in cell.iter(f"{WORD}t")).strip()


def _reader(rows, schema: str, batch_rows: int = 5000):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, data in zip(b["file_id"].to_pylist(), b["content"].to_pylist(), strict=True):
                part: list[tuple] = []
                try:
                    for _ in rows(file_id, data or b""):
                        pass  # a package that breaks midway gives no rows, instead of its first ones
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue  # the probe tells which files can't be read
                for row in rows(file_id, data or b""):
                    part.append(row)
                    if len(part) >= batch_rows:
                        yield batch(part)
                        part = []
                if part:
                    yield batch(part)

    return run


def _of(files: DataFrame, rows, schema: str) -> DataFrame:
    return files.select("file_id", "content").mapInArrow(_reader(rows, schema), schema)


def cells(files: DataFrame) -> DataFrame:
    """Every cell with a value or formula of ``files(file_id, content)``; real addresses count, not the declared size."""
    return _of(files, lambda i, d: workbook_rows(i, d, "cells"), CELLS)


def merges(files: DataFrame) -> DataFrame:
    return _of(files, lambda i, d: workbook_rows(i, d, "merges"), MERGES)


def attachments(files: DataFrame) -> DataFrame:
    return _of(files, lambda i, d: workbook_rows(i, d, "attachments"), ATTACHMENTS)


def layout(files: DataFrame) -> DataFrame:
    return _of(files, layout_rows, LAYOUT)


def blocks(files: DataFrame) -> DataFrame:
    return _of(files, document_rows, BLOCKS)


COMMENTS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
DRAWING = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/vmlDrawing"
AUTHOR = "sheafline"


def patch(template: bytes, values: dict[tuple[str, str], str], notes: dict[tuple[str, str], str] | None = None) -> bytes:
    """The workbook with inline strings and comments in cells ``(sheet name, address)``; styles and all other parts stay as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(template)) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        parts = {part: name for _, name, part in sheets(package)}
        changed: dict[str, bytes] = {}
        for part, sheet in parts.items():
            mine = {ref: v for (s, ref), v in values.items() if s == sheet}
            said = {ref: v for (s, ref), v in (notes or {}).items() if s == sheet}
            if mine:
                changed[part] = _patched(package.read(part), mine)
            if said:
                changed |= _commented(package, part, changed.get(part) or package.read(part), said)
        for name in [*package.namelist(), *(n for n in changed if n not in package.namelist())]:
            if name == "[Content_Types].xml" and any(n.endswith((".vml", "comments.xml")) or "/comments" in n for n in changed):
                new.writestr(name, _typed(package.read(name), changed))
            else:
                new.writestr(name, changed[name] if name in changed else package.read(name))
    return out.getvalue()


def _commented(package: zipfile.ZipFile, part: str, sheet: bytes, notes: dict[str, str]) -> dict[str, bytes]:
    """The parts that give a sheet its comments: text, their shapes, the relationships, the sheet. A cell's own comment stays, with the new one below it."""
    folder, stem = posixpath.dirname(part), posixpath.basename(part).rpartition(".")[0]
    rels = posixpath.join(folder, "_rels", posixpath.basename(part) + ".rels")
    tree = ET.fromstring(package.read(rels)) if rels in package.namelist() else ET.Element(f"{PACKAGE}Relationships")
    known, kinds = relations(package, part), {r.get("Type"): r for r in tree}
    old, texts = kinds.get(COMMENTS), {}
    target = known[old.get("Id")] if old is not None else f"xl/comments_{stem}.xml"
    if old is not None and target in package.namelist():
        texts = {c.get("ref"): "".join(t.text or "" for t in c.iter(f"{MAIN}t")) for c in ET.fromstring(package.read(target)).iter(f"{MAIN}comment")}
    for ref, note in notes.items():
        texts[ref] = f"{texts[ref]}\n\n{note}" if texts.get(ref) else note
    root = ET.Element(f"{MAIN}comments")
    ET.SubElement(ET.SubElement(root, f"{MAIN}authors"), f"{MAIN}author").text = AUTHOR
    held = ET.SubElement(root, f"{MAIN}commentList")
    shapes = []
    for ref in sorted(texts, key=place):
        one = ET.SubElement(ET.SubElement(held, f"{MAIN}comment", {"ref": ref, "authorId": "0"}), f"{MAIN}text")
        ET.SubElement(one, f"{MAIN}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = texts[ref]
        row, col = place(ref)
        shapes.append(f'<v:shape id="note{row}_{col}" type="#_x0000_t202" style="position:absolute;visibility:hidden"><x:ClientData ObjectType="Note"><x:Row>{row - 1}</x:Row><x:Column>{col - 1}</x:Column></x:ClientData></v:shape>')
    drawn = kinds.get(DRAWING)
    shape_part = known[drawn.get("Id")] if drawn is not None else f"xl/drawings/notes_{stem}.vml"
    spaces = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"'
    vml = f"<xml {spaces}>{''.join(shapes)}</xml>"
    if drawn is not None and shape_part in package.namelist():  # other shapes stay; notes are drawn anew
        kept = re.sub(r"(?s)<v:shape\b(?:(?!</v:shape>).)*ObjectType=\"Note\".*?</v:shape>", "", package.read(shape_part).decode("utf-8", "replace"))
        vml = kept.replace("</xml>", "".join(shapes) + "</xml>")
    for kind, at, found in ((COMMENTS, target, old), (DRAWING, shape_part, drawn)):
        if found is None:
            ET.SubElement(tree, f"{PACKAGE}Relationship", {"Id": "notes" if kind == COMMENTS else "noteShapes", "Type": kind, "Target": f"/{at}"})
    out = {target: ET.tostring(root, encoding="UTF-8", xml_declaration=True), shape_part: vml.encode(), rels: ET.tostring(tree, encoding="UTF-8", xml_declaration=True)}
    if drawn is None:
        out[part] = _with_drawing(sheet, "noteShapes")
    else:
        out[part] = sheet
    return out


def _with_drawing(sheet: bytes, rel_id: str) -> bytes:
    """The sheet with its legacy drawing, in the place that the format gives it."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(sheet), events=("start-ns",)):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(sheet)
    later = {f"{MAIN}{n}" for n in ("legacyDrawingHF", "drawingHF", "picture", "oleObjects", "controls", "webPublishItems", "tableParts", "extLst")}
    at = next((k for k, e in enumerate(root) if e.tag in later), len(root))
    root.insert(at, ET.Element(f"{MAIN}legacyDrawing", {f"{REL}id": rel_id}))
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _typed(types: bytes, changed: dict[str, bytes]) -> bytes:
    """The content types with those of comments and their shapes."""
    space = "{http://schemas.openxmlformats.org/package/2006/content-types}"
    root = ET.fromstring(types)
    if not any(e.get("Extension") == "vml" for e in root):
        root.insert(0, ET.Element(f"{space}Default", {"Extension": "vml", "ContentType": "application/vnd.openxmlformats-officedocument.vmlDrawing"}))
    named = {e.get("PartName") for e in root}
    for name in changed:
        if posixpath.basename(name).startswith("comments") and f"/{name}" not in named:
            ET.SubElement(root, f"{space}Override", {"PartName": f"/{name}", "ContentType": "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"})
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def comments(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The comments of a sheet by cell."""
    held = [p for p in relations(package, part).values() if posixpath.basename(p).startswith("comments") and p in package.namelist()]
    return {c.get("ref"): "".join(t.text or "" for t in c.iter(f"{MAIN}t")) for p in held for c in ET.fromstring(package.read(p)).iter(f"{MAIN}comment")}


def _patched(sheet: bytes, values: dict[str, str]) -> bytes:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(sheet), events=("start-ns",)):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(sheet)
    data = root.find(f"{MAIN}sheetData")
    lines = {int(r.get("r")): r for r in data}
    for ref, value in sorted(values.items(), key=lambda x: place(x[0])):
        row, col = place(ref)
        if row not in lines:
            lines[row] = ET.Element(f"{MAIN}row", {"r": str(row)})
            data.insert(sum(r < row for r in lines if r != row), lines[row])
        line = lines[row]
        cell = next((c for c in line if c.get("r") == ref), None)
        if cell is None:
            cell = ET.Element(f"{MAIN}c", {"r": ref})
            line.insert(sum(place(c.get("r"))[1] < col for c in line), cell)
        style = cell.get("s")
        cell.clear()
        cell.attrib.update({"r": ref, "t": "inlineStr"} | ({"s": style} if style else {}))
        ET.SubElement(ET.SubElement(cell, f"{MAIN}is"), f"{MAIN}t").text = value
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)
