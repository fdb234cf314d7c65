"""Commands end to end on authored files."""

from __future__ import annotations

import json

from sheafline import __main__ as commands
from sheafline.operators import evidence, experiments
from sheafline.sources import ooxml
from test_sources import workbook

GOLD = [
    {"field_id": "t", "row_index": 1, "target_cell": "One!C1", "question_text": "机房名称", "expected_value": "东一", "accepted_aliases": ["东1"], "gold_source_chunk_ids": ["k1"]},
    {"field_id": "d", "row_index": 2, "question_text": "巡检日期", "expected_value": "2024-03-05", "field_type": "date", "gold_source_chunk_ids": ["k2"]},
    {"field_id": "g", "row_index": 3, "question_text": "门禁", "expected_value": None, "expected_status": "not_found", "required": False, "must_have_evidence": False},
]
CHUNKS = [
    {"chunk_id": "k0", "text": "机房名称 全部", "answer_value": "全部"},
    {"chunk_id": "k1", "text": "机房名称 东一", "namespace": "east", "source_type": evidence.MAIN, "field_id": "t", "answer_value": "东1"},
    {"chunk_id": "k2", "text": "巡检日期", "namespace": "east", "source_type": evidence.MAIN, "field_id": "d", "answer_value": "2024年3月5号"},
    {"chunk_id": "k3", "text": "门禁 系统", "answer_value": "有"},
]


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_agent_and_metrics(spark, tmp_path):
    gold, corpus = lines(tmp_path / "g.jsonl", GOLD), lines(tmp_path / "c.jsonl", CHUNKS)
    got = {r.field_id: r for r in commands.run_agent(spark, gold, corpus, str(tmp_path / "run"), "east").collect()}
    assert (got["t"].answer_value, got["d"].answer_value, got["d"].repair_action, got["g"].answer_status) == ("东1", "2024-03-05", "repair", "partial_clue")
    pred = lines(tmp_path / "p.jsonl", [{"field_id": r.field_id, "answer_value": r.answer_value, "answer_status": r.answer_status, "confidence": r.confidence, "source_chunk_ids": r.source_chunk_ids} for r in got.values()])
    summary = commands.eval_fields(spark, gold, pred, str(tmp_path / "eval")).first()
    assert summary.field_count == 3 and abs(summary.semantic_match - 2 / 3) < 1e-9 and summary.abstention_precision == 1.0
    trace = spark.read.json(str(tmp_path / "run" / "trace"))
    assert {(r.field_id, r.step) for r in trace.where("step in ('repaired', 'reviewed')").collect()} == {("d", "repaired"), ("g", "reviewed")}
    told = evidence.trace_summary(trace).first()
    assert (told.n_events, told.n_fields, told.n_completed, told.n_answered, told.n_repaired, told.n_reviewed) == (23, 3, 3, 2, 1, 1)
    table = spark.read.option("header", True).csv(str(tmp_path / "eval" / "rows_csv"))
    assert table.count() == 3 and "field_id" in table.columns


def test_baselines(spark, tmp_path):
    gold, corpus = lines(tmp_path / "g.jsonl", GOLD[:1]), lines(tmp_path / "c.jsonl", CHUNKS)
    got = {r.method: r.semantic_match for r in commands.run_baselines(spark, gold, corpus, str(tmp_path / "base"), "east").collect()}
    assert got[experiments.NAIVE] == 0 and got[experiments.FLAT] == got[experiments.LAYERED] == got[experiments.REPAIRED] == 1


def test_workbook(spark, tmp_path, capsys):
    (tmp_path / "t.xlsx").write_bytes(workbook())
    rows = [("a", "C1", "neu", "answered"), ("b", "One!B3", "formula", "answered"), ("c", "B2", "x", "answered"), ("d", "D9", "y", "not_found")]
    pred = lines(tmp_path / "p.jsonl", [{"field_id": f, "target_cell": c, "answer_value": v, "answer_status": s} for f, c, v, s in rows])
    audit = {r.field_id: (r.cell, r.reason) for r in commands.fill_workbook(spark, str(tmp_path / "t.xlsx"), pred, str(tmp_path / "o.xlsx")).collect()}
    assert audit == {"a": ("C1", "written"), "b": ("B3", "skipped_formula"), "c": ("A1", "written"), "d": ("D9", "skipped_status")}
    with ooxml.zipfile.ZipFile(tmp_path / "o.xlsx") as z:
        notes = ooxml.comments(z, "xl/worksheets/sheet1.xml")
    assert set(notes) == {"C1", "A1", "D9"} and notes["D9"].split("\n")[3] == "answer_status: not_found" and notes["C1"].startswith("confidence: 0.0000\nsource_chunk_ids: ")
    cells = {r[5]: r[7] for r in ooxml.workbook_rows("f", (tmp_path / "o.xlsx").read_bytes(), "cells")}
    assert cells["C1"] == "neu" and cells["A1"] == "x" and cells["B3"] == "4"
    told = lines(tmp_path / "t.jsonl", [{"seq": 2, "field_id": "a", "run_id": "late"}, {"seq": 1, "field_id": "a", "trace_id": "early"}, {"seq": 1, "prediction": {"field_id": "d"}, "id": "own"}])
    commands.fill_workbook(spark, str(tmp_path / "t.xlsx"), pred, str(tmp_path / "p.xlsx"), trace=told)
    with ooxml.zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        notes = ooxml.comments(z, "xl/worksheets/sheet1.xml")
    assert {k: v.rpartition("trace_id: ")[2] for k, v in notes.items()} == {"C1": "late", "A1": "", "D9": "own"}
    assert {(r.field_id, r.reason) for r in spark.read.json(str(tmp_path / "p.xlsx.review_items")).collect()} == {("b", "skipped_formula"), ("d", "skipped_status")}
    assert {r.field_id: r.trace_id for r in spark.read.json(str(tmp_path / "p.xlsx.evidence_map")).collect()} == {"a": "late", "b": None, "c": None, "d": "own"}
    commands.main(["show-config"])
    assert json.loads(capsys.readouterr().out)["agent"]["confidence_threshold"] == 0.72
