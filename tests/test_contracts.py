"""Reconciliations, audits of sheets and documents, contracts of answers and templates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sheafline.operators import contracts, reconcile


def test_reconciled(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1), (None, 1), ("z", 0), ("n", None)], "k string, n int")
    b = spark.createDataFrame([("x",), ("x",), ("y",), ("y",), ("w",), (None,)], "k string")
    got = {r.k: (r.n_expected, r.n_actual, r.status) for r in reconcile.reconciled(a, b, ["k"], F.col("n")).collect()}
    assert got == {"x": (2, 2, "equal"), "y": (1, 2, "differs"), None: (1, 1, "equal"), "z": (0, 0, "missing"), "w": (0, 1, "unexpected"), "n": (0, 0, "missing")}
    t = reconcile.totals(reconcile.reconciled(a, b, ["k"], F.col("n"))).first()
    assert (t.n_keys, t.n_equal, t.n_differs, t.n_missing, t.n_unexpected, t.expected, t.actual) == (6, 2, 1, 2, 1, 4, 6)
    assert reconcile.reconciled(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_reconciled_joins_nothing(spark):
    a = spark.range(10).withColumnRenamed("id", "k")
    plan = reconcile.reconciled(a, a, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_audited_segments(spark):
    mapping = spark.createDataFrame([("f", 0, 2, 6), ("g", 0, 1, 2), ("h", 0, 1, 1)], "file_id string, sheet_index int, data_start int, data_end int")
    rows = [("f", 0, 2, "a", None, 1), ("f", 0, 3, " ", None, 0), ("f", 0, 3, "b", "", 0), ("f", 0, 9, "outside", "", 2), ("g", 0, 1, "a", "b", 0), ("g", 0, 2, None, "b", 0)]
    segments = spark.createDataFrame(rows, "file_id string, sheet_index int, row int, capability string, answer string, proof_attachment_count int")
    bound = spark.createDataFrame([("f", 0, 2), ("f", 0, 9), ("f", 0, 5)], "file_id string, sheet_index int, row int")
    got = {r.file_id: tuple(r)[1:] for r in reconcile.audited_segments(mapping, segments, bound).collect()}
    assert got == {"f": (4, 3, 1, 1, "review"), "g": (2, 0, 0, 0, "pass"), "h": (0, 1, 0, 0, "pass")}


def test_audited_documents(spark):
    blocks = [("a", "paragraph", "一、总则"), ("a", "paragraph", " 12、 " + "x" * 40), ("a", "paragraph", "1.2 plain"), ("a", "table_cell", "3、cell"), ("b", "paragraph", None)]
    held = [("a", "word/media/"), ("a", "word/media/i.png"), ("a", None), ("b", "x/noending")]
    made = spark.createDataFrame(blocks, "file_id string, block_type string, text string")
    got = {r.file_id: tuple(r)[1:] for r in reconcile.audited_documents(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "file_id string"), made, spark.createDataFrame(held, "file_id string, media_path string")).collect()}
    assert got == {"a": (3, 1, 1, 1, 3, 2, "review_media"), "b": (1, 0, 0, 0, 1, 1, "review_media"), "c": (0, 0, 0, 0, 0, 0, "pass")}
    assert sorted((r.length, r.is_short) for r in reconcile.headings(made).collect()) == [(4, True), (44, False)]


def test_checked(spark):
    full = {"answer_value": "5 kW", "confidence": 0.5, "source_chunks": ["c"]}
    cases = [
        ("cell_answer", json.dumps(full), [], []), ("cell_answer", "It is ```json\n" + json.dumps(full | {"extra": 1, "notes": "n"}) + "\n``` so", [], ["extra"]),
        ("cell_answer", json.dumps(full | {"answer_value": " ", "source_chunks": [], "confidence": "high"}), ["missing answer_value", "missing source_chunks", "confidence must be between 0 and 1"], []),
        ("cell_answer", json.dumps(full | {"confidence": None}), ["missing confidence"], []), ("cell_answer", json.dumps(full | {"confidence": 1.01}), ["confidence must be between 0 and 1"], []),
        ("finding_row", json.dumps({"category": "a", "question": "b", "status": "满足", "current_info": "c", "source_chunks": [{"chunk_id": "x"}]}), ["status is none of its values"], []),
        ("nothing", "{}", ["unknown mode"], []), (None, "{}", ["unknown mode"], []), ("cell_answer", "no", ["no JSON object"], []), ("cell_answer", None, ["no JSON object"], []), ("risk_row", "{}", [f"missing {f}" for f in contracts.REQUIRED["risk_row"]], []),
    ]
    got = contracts.checked(spark.createDataFrame([(i, m, a) for i, (m, a, _, _) in enumerate(cases)], "i int, mode string, answer string")).orderBy("i").collect()
    assert [(r.problems, r.unknown_fields) for r in got] == [(p, u) for _, _, p, u in cases]
    rows = contracts.contract_rows(spark)
    assert rows.where("required").groupBy("mode").count().orderBy("mode").collect()[0]["count"] == 3
    assert rows.count() == rows.select("mode", "field").distinct().count()


def sheets(spark):
    rows = [("m", "assessment_matrix", None, True, True), ("l", "layout", "cell_answer", None, None), ("f", "fill_form", contracts.LAYOUT, False, False), ("r", "risk_register", "finding_row", False, None), ("n", None, "odd", None, None)]
    return spark.createDataFrame(rows, "sheet string, sheet_kind string, hinted_mode string, has_sample boolean, needs_evidence boolean")


def test_templates(spark):
    got = {r.sheet: (r.mode, r.include_fields[3:], r.auxiliary_fields, r.needs_evidence) for r in contracts.templates(sheets(spark)).collect()}
    assert got == {
        "m": ("status_with_current_info", ["status", "current"], ["instruction", "sample"], True), "l": (contracts.LAYOUT, [], ["instruction"], False), "f": ("cell_answer", [], ["instruction"], False),
        "r": ("finding_row", ["target", "current"], ["instruction"], False), "n": ("cell_answer", [], ["instruction"], False),
    }


def test_revised(spark):
    told = {"m": '```{"rag_return_mode": "risk_row", "include_fields": [], "retrieval_policy": {"layers": ["meta", "odd"], "vector_top_k": 7}}```', "l": '{"rag_return_mode": "cell_answer"}', "f": '{"rag_return_mode": "odd", "auxiliary_fields": ["z"]}', "r": "no"}
    made = contracts.templates(sheets(spark)).join(spark.createDataFrame(list(told.items()), "sheet string, response string"), "sheet", "left")
    got = {r.sheet: (r.template_source, r.mode, len(r.include_fields), r.auxiliary_fields, tuple(r.retrieval)) for r in contracts.revised(made).collect()}
    usual = (["fact", "evidence"], 40, 10)
    assert got == {
        "m": ("model", "risk_row", 5, ["instruction", "sample"], (["meta"], 7, 10)), "l": ("model", contracts.LAYOUT, 3, ["instruction"], usual), "f": ("model", "cell_answer", 3, ["z"], usual),
        "r": ("deterministic", "finding_row", 5, ["instruction"], usual), "n": ("deterministic", "cell_answer", 3, ["instruction"], usual),
    }


def test_inputs_and_prompts(spark):
    rows = [("m", i, {"question": f" q {i} ", "category": "", "status": "ok", "current": None, "target_namespace": "dc1", "answer": "secret", "sample": "s"}) for i in range(12)] + [("zz", 1, {"question": "x"})]
    items = spark.createDataFrame(rows, "sheet string, i int, fields map<string,string>")
    made = contracts.templates(sheets(spark))
    got = {r.i: (r.query_text, r.help_text) for r in contracts.inputs(items, made, "sheet").collect()}
    assert len(got) == 12 and got[3] == ("dc1 q 3 ok", "s")
    told = {r.sheet: json.loads(r.prompt.partition("\n")[2]) for r in contracts.prompts(made, items, "sheet", "i", 3).collect()}
    assert told["m"]["sample_items"] == ["q 0", "q 1", "q 2"] and told["l"]["sample_items"] == [] and len(told) == 5
    assert not any("secret" in json.dumps(t) for t in told.values())
