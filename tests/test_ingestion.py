"""The expanded manifest: namespaces in order, three sources, and which record of an id stays."""

from __future__ import annotations

from sheafline.operators import ingestion

FILES = "file_id string, file_name string, relative_path string, document_role string, data_center_id string"
ROUTED = "file_id string, data_center_id string, route_candidates array<string>"
BLOCKS = "file_id string, block_index long, block_type string, style string, level int, table_index int, row int, col int, text string"
SEGMENTS = "segment_id string, segment_type string, raw_text string, embedding_text string, data_center_id string, embedded_file_type string, embedded_file_name string, local_part string, parent_file_id string, parent_file_name string, parent_sheet_name string, parent_source_cell string, parent_segment_id string, parent_attachment_id string"


def made(spark):
    files = spark.createDataFrame([("a", "a.docx", "in/a.docx", "intro_doc", "dc1"), ("b", "b.docx", "in/b.docx", "intro_doc", ""), ("c", "c.docx", "in/c.docx", "intro_doc", None), ("k", "k.xlsx", "k.xlsx", "knowledge_base", None), ("s", "s.xlsx", "s.xlsx", "survey_form", None)], FILES)
    routed = spark.createDataFrame([("a", "dc9", ["x", "", None, "y"]), ("b", "dc2", None), ("c", None, ["p"])], ROUTED)
    return files, routed


def test_namespaces(spark):
    got = {r.file_id: (r.namespace, r.namespace_source, r.namespace_candidates) for r in ingestion.namespaces(*made(spark)).collect()}
    assert got == {"a": ("dc1", "file", ["x", "y"]), "b": ("dc2", "routed", []), "c": ("global", "default", ["p"]), "k": ("global", "default", []), "s": ("global", "default", [])}


def test_introductions(spark):
    p = lambda f, i, t: (f, i, "paragraph", None, 0, None, None, None, t)
    c = lambda f, i, t, r, k, x: (f, i, "table_cell", None, 0, t, r, k, x)
    blocks = [p("a", 1, " First  line "), c("a", 2, 1, 1, 1, "Name"), c("a", 2, 1, 1, 2, ""), c("a", 2, 1, 2, 1, "Hall"), c("a", 2, 1, 2, 2, "7"), c("a", 2, 1, 2, 4, "more"), c("a", 2, 1, 3, 1, " "), p("a", 3, "Second"), p("a", 4, "  "), p("k", 1, "no intro"), c("b", 1, 2, 2, 1, "late"), c("b", 1, 2, 3, 1, "x")]
    got = ingestion.intro_records(*made(spark), spark.createDataFrame(blocks, BLOCKS))
    rows = {r.anchor: r for r in got.collect()}
    assert {k: r.raw_text for k, r in rows.items()} == {
        "a.docx!paragraph 1": "First line", "a.docx!paragraph 2": "Second", "a.docx!table 1 row 1": "Name", "a.docx!table 1 row 2": "Name：Hall；7；列4：more",
        "b.docx!table 2 row 2": "late：late", "b.docx!table 2 row 3": "late：x",
    }
    one = rows["a.docx!table 1 row 2"]
    assert one.text_for_embedding == "数据中心：dc1。文件：a.docx。文档类型：机房情况说明介绍。位置：表1 行2。内容：Name：Hall；7；列4：more。"
    assert (one.chunk_id[:6], len(one.chunk_id), one.table_id, one.retrieval_tags, one.namespace_candidates) == ("intro_", 22, "intro_table_a_1", ["intro_doc", "intro_doc_table", "dc1", "a.docx"], ["x", "y"])
    assert rows["a.docx!paragraph 1"].text_for_embedding == "数据中心：dc1。文件：a.docx。文档类型：机房情况说明介绍。位置：段落1。内容：First line。"


def test_embedded(spark):
    files, _ = made(spark)
    row = lambda i, kind="docx", type_="embedded_docx_row", raw="text", told=None, dc=None, parent="k", cell="B2": (i, type_, raw, told, dc, kind, "e", "table_row", parent, "k.xlsx", "Sheet", cell, "seg", "att")
    rows = [row("1", dc=" dc3 "), row("2", kind=" DWG "), row("3", type_="Image_ocr"), row("4", raw="  "), row("5", parent="s"), row("6", told="other  text", cell=None), row("7", told="", parent="none")]
    got = {r.source_segment_id: r for r in ingestion.embedded_records(spark.createDataFrame(rows, SEGMENTS), files).collect()}
    assert sorted(got) == ["1", "6", "7"]
    assert (got["1"].namespace, got["1"].namespace_source, got["1"].anchor, got["1"].proof_cell_refs, got["1"].relative_path) == ("dc3", "segment", "Sheet!B2 docx table_row", ["B2"], "k.xlsx")
    assert (got["6"].namespace, got["6"].text_for_embedding, got["6"].raw_text, got["6"].proof_cell_refs) == ("global", "other text", "text", [])
    assert (got["7"].text_for_embedding, got["7"].relative_path) == ("text", "k.xlsx")


def test_the_earliest_source_stays(spark):
    base = ingestion.curated_records(spark.createDataFrame([("x", "curated", True), ("y", "  ", True), ("z", "also", False)], "chunk_id string, text_for_embedding string, default_index boolean"))
    later = ingestion._shaped(spark.createDataFrame([("x", "later", "s"), ("y", "later", "s"), ("y", "earlier", "s")], "chunk_id string, text_for_embedding string, full_store_source string"))
    got = ingestion.expanded_manifest([base, later])
    assert {r.chunk_id: (r.text_for_embedding, r.full_store_source, r.manifest_default_index) for r in got.collect()} == {"x": ("curated", ingestion.CURATED, True), "y": ("earlier", "s", None), "z": ("also", ingestion.CURATED, False)}
    counts = {(r.facet, r.value): r.n for r in ingestion.manifest_summary([base, later], got).collect()}
    assert counts["total_records", "all"] == 3 and counts["duplicate_chunk_ids_skipped", "all"] == 2 and counts["full_store_source", "s"] == 1


def test_empty_sources(spark):
    none = spark.createDataFrame([], FILES), spark.createDataFrame([], ROUTED)
    intro = ingestion.intro_records(*none, spark.createDataFrame([], BLOCKS))
    assert ingestion.expanded_manifest([intro, ingestion.embedded_records(spark.createDataFrame([], SEGMENTS), none[0])]).count() == 0
