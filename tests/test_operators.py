"""Operators on small cases, and the registered queries' contract."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from sheafline.operators import evidence, forms, manifest, metrics, order, retrieval, segments, tables, writeback


def test_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in order.keep_first(df, ["k"], ["o"]).collect()) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(tuple(r) for r in order.keep_last(df, ["k"], ["o"]).collect()) == [("a", 2, "x"), ("b", 5, "z")]
    ahead = df.select("k", "o", order.carry_forward(F.col("v"), ["k"], ["o"], look_ahead=True).alias("v"))
    assert sorted(tuple(r) for r in ahead.collect()) == [("a", 1, "x"), ("a", 2, "x"), ("b", 5, "z")]


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_heading_paths(spark, width):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for doc in [*range(8), None]:
        path: list[str | None] = []
        for o in range(30):
            level, title = int(rng.integers(0, 5)), f"h{o}" if rng.random() < 0.9 else None
            if level:
                path = [*path[: level - 1], title]
            rows.append((doc, o * 2, level or (None if rng.random() < 0.5 else 0), title))
            want[doc, o * 2] = path
    table = spark.createDataFrame(rows, "d int, o int, l int, t string")
    for deepest in (None, 9):
        got = order.heading_paths(table, "d", "o", "l", "t", deepest=deepest, width=width).collect()
        assert len(got) == len(rows) and {(r.d, r.o): r.heading_path for r in got} == want


def test_heading_paths_without_headings(spark):
    plain = order.heading_paths(spark.createDataFrame([(1, 1, 0, "x"), (1, None, None, None)], "d int, o int, l int, t string"), "d", "o", "l", "t")
    assert [r.heading_path for r in plain.collect()] == [[], []]
    assert order.heading_paths(plain.drop("heading_path").where("d > 1"), "d", "o", "l", "t").count() == 0
    # rows of one place go by level and text
    same = order.heading_paths(spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 1, "a"), (1, 2, 0, "x")], "d int, o int, l int, t string"), "d", "o", "l", "t")
    assert sorted((r.t, r.heading_path) for r in same.collect()) == [("a", ["a"]), ("b", ["b"]), ("x", ["b"])]


def test_vector_and_layers(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[7] = 0
    rows = [(i, v.tolist(), "t" if i % 2 else "g", f"l{i % 3}", "s") for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<float>, namespace string, corpus_layer string, source_type string").repartition(3)
    asked = spark.createDataFrame([(0, vectors[3].tolist(), "t"), (1, vectors[4].tolist(), "g")], "query_id long, vector array<float>, namespace string")
    plan = retrieval.Plan(layers=(retrieval.Layer("a", "target", ("l0",), (), 4), retrieval.Layer("b", "any", (), (), 5)), least=None, global_namespace="g")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.vector_topk(asked, chunks, plan).collect()}
    for q, (at, ns) in enumerate(((3, "t"), (4, "g"))):
        cos = [(-float(np.dot(vectors[at].astype(float), v.astype(float)) / (np.linalg.norm(vectors[at].astype(float)) * (np.linalg.norm(v.astype(float)) or 1))), i) for i, v in enumerate(vectors)]
        first = [i for _, i in sorted(c for c in cos if rows[c[1]][2] == ns and rows[c[1]][3] == "l0")[:4]]
        second = [i for _, i in sorted(cos)[:5] if i not in first]
        assert [got[q, k + 1] for k in range(len(first) + len(second))] == first + second


def candidates(spark, rows):
    return spark.createDataFrame([(f, k, "T", c, n, s, a, "answered", float(x)) for f, k, c, n, s, a, x in rows], "field_id string, field_type string, target string, chunk_id string, namespace string, source_type string, answer_value string, answer_status string, score double")


def test_evidence_decisions(spark):
    main, emb, intro = evidence.MAIN, evidence.EMBEDDED, evidence.INTRO
    rows = [
        ("direct", "text", "c1", "T", main, "A", 0.5), ("direct", "text", "c2", "T", emb, "B", 0.9),
        ("clue", "text", "c3", "G", main, "A", 0.9),
        ("conflict", "text", "c4", "T", main, "A", 0.5), ("conflict", "text", "c5", "T", main, "B", 0.5), ("conflict", "text", "c6", "T", intro, "C", 0.5),
        ("same", "bool", "c7", "T", main, "是", 0.5), ("same", "bool", "c8", "T", main, "yes", 0.6),
        ("swap", "bool", "c9", "T", main, "待复核", 0.5), ("swap", "bool", "c10", "T", emb, "无", 0.5),
        ("none", "text", "c11", "T", main, "未找到", 0.5),
    ]
    got = {r.field_id: (r.decision, r.chunk and r.chunk.chunk_id, r.chunk_ids) for r in evidence.select_evidence(candidates(spark, rows)).collect()}
    assert got == {
        "direct": ("use_direct_evidence", "c1", []), "clue": ("clue_only", None, ["c3"]), "conflict": ("conflict_unresolved", None, ["c4", "c5"]),
        "same": ("use_direct_evidence", "c8", []), "swap": ("use_direct_evidence", "c10", []), "none": ("no_evidence", None, []),
    }


def test_agent_repairs_and_reviews(spark):
    rows = [("d", "date", "c1", "T", evidence.MAIN, "2024年3月5号", 0.9), ("e", "enum", "c2", "T", evidence.MAIN, "双路供电", 0.9), ("g", "text", "c3", "G", evidence.MAIN, "x", 0.9)]
    schema = "field_id string, field_type string, required boolean, must_have_evidence boolean, regex string, option_values array<string>, aliases array<string>, min double, max double"
    fields = spark.createDataFrame([("d", "date", True, True, "", [], [], None, None), ("e", "enum", True, True, "", ["双路", "单路"], [], None, None), ("g", "text", True, True, "", [], [], None, None), ("h", "text", True, True, "", [], [], None, None)], schema)
    ran = evidence.run_fields(fields, candidates(spark, rows))
    got = {r.field_id: (r.answer_value, r.answer_status, r.repair_action, r.review_reason) for r in ran.collect()}
    assert got == {"d": ("2024-03-05", "answered", "repair", None), "e": ("双路", "answered", "repair", None), "g": ("未找到", "partial_clue", "review", "partial_clue"), "h": ("未找到", "not_found", "review", "not_found")}
    steps = {}
    for r in evidence.trace(ran, "r").orderBy("seq").collect():
        steps.setdefault(r.field_id, []).append(r.step)
    plain = [s for s in evidence.STEPS if s not in ("repaired", "reviewed")]
    assert steps == {f: plain[:-1] + [e] + plain[-1:] for f, e in (("d", "repaired"), ("e", "repaired"), ("g", "reviewed"), ("h", "reviewed"))}


def test_metrics_of_five_types(spark):
    schema = "field_id string, expected_value string, expected_status string, aliases array<string>, field_type string, required boolean, must_have_evidence boolean, gold_ids array<string>, regex string, options array<string>, min double, max double"
    golds = [
        ("t", "一号机房", "answered", ["1号机房"], "text", True, True, ["a"], "", [], None, None), ("e", "双路市电", "answered", ["两路供电"], "enum", True, True, ["b"], "", ["双路市电", "单路"], None, None),
        ("n", "120 kW", "answered", [], "number", True, True, ["c"], "", [], 1.0, 500.0), ("d", "2024-03-05", "answered", [], "date", True, False, [], "", [], None, None), ("b", "是", "answered", [], "bool", True, True, ["d"], "", [], None, None),
    ]
    told = [("t", 1, "old", "answered", 0.9, []), ("t", 2, "1号机房", "answered", 0.9, ["a"]), ("e", 1, "两路供电", "answered", 0.9, ["b"]), ("n", 1, "120000W", "answered", 0.9, ["c"]), ("d", 1, "2024/3/5", "answered", 0.9, []), ("b", 1, "支持", "answered", 0.9, [])]
    rows = metrics.evaluate(spark.createDataFrame(golds, schema), spark.createDataFrame(told, "field_id string, ordinal int, answer_value string, answer_status string, confidence double, source_ids array<string>"))
    s = metrics.summarize(rows).first()
    assert (s.field_count, s.exact_match, s.semantic_match, s.status_accuracy) == (5, 0.0, 1.0, 1.0)
    assert (round(s.evidence_support, 6), s.evidence_recall, s.abstention_precision, s.review_rate, s.correction_rate) == (0.6, 0.75, 0.0, 0.2, 0.0)
    bad = {r.field_id: r.badcases for r in rows.collect()}
    assert bad["b"] == ["evidence_low_recall", "evidence_missing", "exact_mismatch", "needs_human_review"]


def test_p95(spark):
    values = [float(x) for x in np.random.default_rng(2).integers(0, 50, 37)]
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v double")
    assert metrics.p95(df, "v", "k").first().p95 == sorted(values)[round(36 * 0.95)]


@pytest.mark.parametrize(("share", "apart"), [(0.95, 0.001), (0.95, 0.0), (0.5, 0.2), (0.0, 0.1), (1.0, 0.1)])
def test_p95_of_groups(spark, share, apart):
    """Skewed, equal, few and negative values, a null group and one of nulls alone; cuts that are far off don't matter."""
    rng = np.random.default_rng(3)
    groups = {"exp": np.exp(rng.normal(0, 4, 1500)), "same": np.full(700, 3.0), "one": np.array([5.0]), None: rng.normal(0, 1, 333), "whole": rng.integers(-9, 9, 1001).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double").repartition(7)
    got = {r.k: (r.p95, r.n) for r in metrics.p95(df, "v", "k", share=share, apart=apart).collect()}
    assert got == {k: (sorted(vs)[round((len(vs) - 1) * share)], len(vs)) for k, vs in groups.items()}
    every = np.sort(np.concatenate(list(groups.values())))
    assert [tuple(r) for r in metrics.p95(df, "v", share=share, apart=apart).collect()] == [(every[round((len(every) - 1) * share)], len(every))]
    assert metrics.p95(df.where("false"), "v", "k").count() == 0


def test_segments_and_forms(spark):
    grid = [(1, ["title"]), (2, ["分类", "项目", "能力描述", "现状", "证明"]), (3, ["电力", "市电", "双路", "有", ""]), (4, ["", "UPS", "容量", "无", ""]), (5, ["", "", "", "x", ""])]
    cells = spark.createDataFrame([("f", 0, r, c + 1, v) for r, vs in grid for c, v in enumerate(vs) if v], "file_id string, sheet_index int, row int, col int, value string")
    head = segments.header_rows(cells)
    assert [(r.header_row, r.score) for r in head.collect()] == [(2, 12)]
    pictures = spark.createDataFrame([("f", 0, 3, 5, "p2"), ("f", 0, 3, 6, "p1"), ("f", 0, 4, 1, "far")], "file_id string, sheet_index int, row int, col int, attachment_id string")
    got = {r.row: r for r in segments.row_segments(cells, head, pictures).collect()}
    assert set(got) == {3, 4} and got[4].category == "电力" and got[3].proof_attachments == ["p1", "p2"] and got[4].proof_attachments == []
    assert got[3].embedding_text == "category：电力。item：市电。capability：双路。answer：有。"
    merges = spark.createDataFrame([("f", 0, 3, 5, 1, 2)], "file_id string, sheet_index int, first_row int, last_row int, first_col int, last_col int")
    filled = {(r.row, r.col): r.value for r in segments.inherited(cells, merges).collect()}
    assert filled[4, 1] == filled[5, 1] == filled[5, 2] == "电力" and filled[4, 2] == "UPS"
    form = spark.createDataFrame([("f", 0, r, c + 1, v) for r, vs in [(1, ["问题", "填写"]), (2, ["是否双路", ""]), (3, ["截图证明", "done"])] for c, v in enumerate(vs) if v], "file_id string, sheet_index int, row int, col int, value string")
    items = {r.row: r for r in forms.items(form, forms.profiles(form)).collect()}
    assert (items[2].target_cell, items[2].answer_state, items[3].needs_evidence, items[3].answer_state) == ("B2", "empty", True, "filled")
    asked = {r.answer_type for r in forms.requests(forms.items(form, forms.profiles(form)), "dc").collect()}
    assert asked == {"bool", "text"}


def test_tables(spark):
    rows = [("g", "team", 1, ["name", "phone"]), ("g", "team", 2, ["Unit A", "", ""]), ("g", "team", 3, ["bob", "1"]), ("g", "team", 4, ["", ""]), ("s", "steps", 1, ["open"]), ("s", "steps", 2, ["close"]), ("c", "cab", 1, ["room", "n"]), ("c", "cab", 2, ["", "4"]), ("c", "cab", 3, ["r1", "5"]), ("o", "only", 1, ["x", "y"])]
    df = spark.createDataFrame(rows, "table_id string, category string, row int, values array<string>")
    specs = [tables.Spec("team", grouped=True), tables.Spec("steps", "steps", data_start=1, role="instruction_step"), tables.Spec("cab", fill_first=True), tables.Spec("only", "schema")]
    found = tables.resolve(df, specs)
    assert sorted((r.table_id, r.row, r.text) for r in found.collect()) == [("c", 2, "room：r1；n：4"), ("c", 3, "room：r1；n：5"), ("g", 3, "Unit A：name：bob；phone：1"), ("o", 1, "x；y"), ("s", 1, "1. open"), ("s", 2, "2. close")]
    assert tables.aggregates(found, ["steps"]).first().text == "1. 1. open\n2. 2. close"
    skips = spark.createDataFrame([("g", 1), ("g", 2), ("g", 4)], "table_id string, row int")
    status = {r.table_id: (r.status, r.confidence) for r in tables.table_status(df, found, skips).collect()}
    assert status == {"g": ("resolved", "high"), "s": ("resolved", "high"), "c": ("needs_review", "low"), "o": ("schema_only", "medium")}


def test_writeback(spark):
    rows = [("a", "C4", "answered", True), ("b", "'My ''S'!d5", "answered", True), ("c", "C4", "answered", True), ("d", "E9", "not_found", True), ("e", "oops", "answered", True), ("f", "F1", "answered", False), ("g", "E2", "answered", True), ("h", "G7", "answered", True)]
    told = spark.createDataFrame(rows, "field_id string, target_cell string, answer_status string, validation_pass boolean").withColumns({"evidence_missing": F.lit(False), "violations": F.array().cast("array<string>")})
    merges = spark.createDataFrame([("S1", 1, 2, 5, 5)], "sheet_name string, first_row int, last_row int, first_col int, last_col int")
    formulas = spark.createDataFrame([("S1", 7, 7)], "sheet_name string, row int, col int")
    audit = writeback.actions(writeback.targets(told, "S1", merges), formulas)
    got = {r.field_id: (r.sheet_name, r.cell, r.reason) for r in audit.collect()}
    assert got == {"a": ("S1", "C4", "duplicate_target_cell"), "c": ("S1", "C4", "duplicate_target_cell"), "b": ("My 'S", "D5", "written"), "d": ("S1", "E9", "skipped_status"), "e": ("S1", None, "invalid_cell"), "f": ("S1", "F1", "validation_failed"), "g": ("S1", "E1", "written"), "h": ("S1", "G7", "skipped_formula")}
    assert tuple(writeback.summary(audit).first()) == (8, 2, 3, 2, 1, 6)


def test_manifest(spark):
    a = spark.createDataFrame([(1, "x"), (2, " ")], "id long, text string")
    b = spark.createDataFrame([(1, "y", 5), (3, "z", 6)], "id long, text string, n int")
    assert sorted((r.id, r.text, r.n) for r in manifest.union_first([a, b], "id").collect()) == [(1, "x", None), (3, "z", 6)]


def test_catalogue(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("size", [1, 3, 500])
def test_fixed_chunks(spark, size):
    texts = {1: "abcdefg", 2: "", 3: None, 4: "a\n\r\u2028b😀c😀😀é中\n", 5: "x😀" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    parts = {}
    for r in retrieval.fixed_chunks(df, size).orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(r.chunk_text)
    assert parts == {i: [t[k : k + size] for k in range(0, len(t), size)] if t else [""] for i, t in texts.items()}
