"""Interval joins against brute force; sheet summaries, hidden cells and anchors of legacy drawings."""

from __future__ import annotations

import random

import pytest
from sheafline.operators import intervals
from sheafline.sources import ooxml, sheets
from test_sources import R, S, package

POINTS, RANGES = "k string, at long, p long", "k string, first long, last long, r long"


def tables(spark, points, ranges):
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_and_cover(spark, seed):
    rng = random.Random(seed)
    wide = 10 ** rng.choice([1, 2, 9])
    points = [(rng.choice("ab"), rng.randint(-wide, wide), i) for i in range(120)] + [(None, 3, 900), ("a", None, 901), ("a", 7, 902), ("a", 7, 903)]
    ranges = []
    for i in range(60):
        first = rng.randint(-wide, wide)
        ranges.append((rng.choice("abc"), first, first + rng.choice([0, 0, 1, 2, 7, 8, wide, -1]), i))
    ranges += [(None, 0, 9, 800), ("a", None, 9, 801), ("b", -(2**40), 2**40, 802), ("a", 7, 7, 803), ("a", 7, 7, 804)]
    p, r = tables(spark, points, ranges)
    want = sorted((x[2], y[3]) for x in points for y in ranges if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1]) and y[1] <= x[1] <= y[2])
    assert sorted((x.p, x.r) for x in intervals.interval_pairs(p, r, ["k"], "at", "first", "last").collect()) == want
    flags = {x.p: x.hit for x in intervals.with_cover(p, r, ["k"], "at", "hit").collect()}
    assert flags == {x[2]: x[2] in {a for a, _ in want} for x in points}
    covered = {x.k: x.n for x in intervals.covered_length(r.where("r <> 802"), ["k"], "n").collect()}
    for key, n in covered.items():
        mine = sorted((a, b) for k, a, b, i in ranges if k == key and i != 802 and a is not None and a <= b)
        reached, total = None, 0
        for a, b in mine:
            a = a if reached is None else max(a, reached + 1)
            if b >= a:
                total, reached = total + b - a + 1, b
        assert n == total


def test_no_ranges(spark):
    p, r = tables(spark, [("a", 1, 1)], [])
    assert intervals.interval_pairs(p, r, ["k"], "at", "first", "last").count() == 0
    assert [x.hit for x in intervals.with_cover(p, r, ["k"], "at", "hit").collect()] == [False]
    assert intervals.interval_pairs(*tables(spark, [], [("a", 1, 2, 3)]), ["k"], "at", "first", "last").count() == 0


def test_a_wide_range_is_two_rows(spark):
    _, r = tables(spark, [], [("a", 1, 2**40, 1), ("a", 5, 5, 2), ("a", 3, 4, 3)])
    placed = intervals._placed(r, "first", "last").groupBy("r").count().collect()
    assert {x.r: x["count"] for x in placed} == {1: 2, 2: 1, 3: 2}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_not_broadcast(spark):
    p, r = tables(spark, [("a", 1, 1)], [("a", 1, 2, 3)])
    assert "Broadcast" not in plan_of(intervals.interval_pairs(p, r, ["k"], "at", "first", "last"))


def test_cover_over_many_buckets_spreads_no_place(spark):
    wide = 1 << intervals.PLACES
    points = [("a", at, i) for i, at in enumerate((-wide, 0, 5, wide, 3 * wide, 3 * wide + 1, 9 * wide))] + [("b", 0, 90), (None, 3, 91), ("a", None, 92), ("a", 5, 93)]
    p, r = tables(spark, points, [("a", 4, 3 * wide, 1), ("a", 4, 6, 2), ("a", wide, wide, 3), ("a", -wide, -wide, 4), (None, 0, 9, 5)])
    flagged = intervals.covered(p, r, ["k"], "at", "hit")
    assert {x.p: x.hit for x in flagged.collect()} == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 90: False, 91: False, 92: False, 93: True}
    assert "Generate" not in plan_of(intervals.with_cover(p, r, ["k"], "at", "hit"))
    assert {x.k: x.n for x in intervals.covered_length(r, ["k"], "n").collect()} == {"a": 3 * wide - 4 + 2, None: 10}


V = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"'


def book():
    rows = '<row r="1"><c r="A1" s="7"><v>1</v></c><c r="C1"><f>A1+1</f><v>2</v></c></row><row r="2" hidden="1"><c r="B2"><v>3</v></c></row><row r="3" hidden="1"/><row r="5" hidden="true"><c r="C5"><v>4</v></c></row>'
    cols = '<cols><col min="3" max="16384" hidden="1"/><col min="1" max="1" width="9"/></cols>'
    ole = '<oleObjects><oleObject progId="Package" shapeId="1025" r:id="o1"/><oleObject progId="Package" shapeId="1026" r:id="o2"/><oleObject progId="Package" shapeId="1027" r:id="o3"/></oleObjects>'
    shapes = '<v:shape id="_x0000_s1025"><v:imagedata o:relid="p1"/><x:ClientData ObjectType="Pict"><x:Anchor> 2, 15, 4, 10, 5, 1, 9, 2</x:Anchor></x:ClientData></v:shape><v:shape id="sh" o:spid="_x0000_s1026"><x:ClientData><x:Anchor>a, b</x:Anchor></x:ClientData></v:shape><v:shape id="other"/>'
    return package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/><sheet name="Gone" sheetId="3" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><dimension ref="A1:Z99"/>{cols}<sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells><legacyDrawing r:id="v1"/>{ole}</worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {R}><Relationship Id="v1" Target="../drawings/vml1.vml"/><Relationship Id="o1" Target="../embeddings/a.bin"/><Relationship Id="o2" Target="../embeddings/b.bin"/><Relationship Id="o3" Target="../embeddings/c.bin"/></Relationships>',
        "xl/drawings/vml1.vml": f"<xml {V}>{shapes}</xml>",
        "xl/drawings/_rels/vml1.vml.rels": f'<Relationships {R}><Relationship Id="p1" Target="../media/preview.emf"/></Relationships>',
    })


def test_summaries(spark):
    files = spark.createDataFrame([("f", bytearray(book()))], "file_id string, content binary")
    found = sheets.summarised(files)
    rows = {r.sheet_name: r for r in found.collect()}
    one = rows["One"]
    assert (one.declared_dimension, one.actual_min_cell, one.actual_max_cell, one.actual_dimension, one.parse_status) == ("A1:Z99", "A1", "C5", "A1:C5", "ok")
    assert (one.non_empty_cell_count, one.formula_count, one.merge_count, one.attachment_count) == (4, 1, 1, 3)
    assert (one.hidden_row_count, one.hidden_col_count, one.hidden_cell_count) == (3, 16382, 3)
    assert (rows["Empty"].actual_dimension, rows["Empty"].non_empty_cell_count, rows["Empty"].parse_status) == (None, 0, "ok")
    assert rows["Gone"].parse_status == "missing_part"
    total = sheets.workbook_summaries(found).first()
    assert (total.sheet_count, total.total_cell_count, total.diagnostics) == (2, 4, ["worksheet missing: Gone"])
    cells = {r.cell: (r.is_hidden_row, r.is_hidden_col, r.style) for r in sheets.with_hidden(ooxml.cells(files), ooxml.layout(files)).collect()}
    assert cells == {"A1": (False, False, 7), "C1": (False, True, None), "B2": (True, False, None), "C5": (True, True, None)}


def test_anchors_of_legacy_drawings(spark):
    files = spark.createDataFrame([("f", bytearray(book()))], "file_id string, content binary")
    got = {r.attachment_id: (r.row, r.col, r.preview_path) for r in ooxml.attachments(files).collect()}
    assert got == {"att_f_1025_ole": (5, 3, "xl/media/preview.emf"), "att_f_1026_ole": (None, None, None), "att_f_1027_ole": (None, None, None)}
