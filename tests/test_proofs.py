"""As-of joins, traces, evidence, citations: against brute force and cases by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sheafline.operators import asof, proofs, writeback

PREDICTED = "field_id string, n int, target_cell string, answer_status string, confidence double, source_chunk_ids array<string>, evidence_attachment_ids array<string>, trace_id string"


def test_asof_by_brute_force(spark):
    draw = random.Random(5)
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", "only", None])
    left = [(i, key(), draw.choice([None, *range(-40, 400)])) for i in range(400)] + [(1, "hot", 50), (1, "hot", 50)]
    right = [(key() or "x", draw.choice([None, *range(-60, 380)]), draw.randrange(100)) for _ in range(300)] + [(None, 3, 1)]
    right = [r for r in right if r[0] != "only"]
    want = []
    for i, k, at in left:
        seen = [] if k is None or at is None else [(t, v) for q, t, v in right if q == k and t is not None and t <= at]
        best = max(seen, default=(None, None))
        want.append((i, k, at, best[1], best[0]))
    a, b = spark.createDataFrame(left, "i int, k string, at long"), spark.createDataFrame(right, "k string, at long, v int")
    for width in (1, 37, 10_000):
        got = asof.asof(a, b, ["k"], "at", ["v"], width)
        assert got.columns == ["i", "k", "at", "v", "at_matched"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_asof_of_empty_tables(spark):
    a, b = spark.createDataFrame([(1, "x", 5)], "i int, k string, at long"), spark.createDataFrame([], "k string, at long, v int")
    assert [tuple(r) for r in asof.asof(a, b, ["k"], "at", ["v"], 10).collect()] == [(1, "x", 5, None, None)]
    assert asof.asof(a.limit(0), b, ["k"], "at", ["v"], 10).count() == 0


def test_trace_index(spark):
    rows = [(1, "f", None, "t1", "i1", "r"), (2, "", ("f",), "", "i2", "r"), (3, "g", ("f",), None, None, "r3"), (4, None, ("h",), "t4", None, None), (5, None, None, "t5", None, None), (6, "h", None, "", None, None), (4, "h", None, "t0", None, None)]
    events = spark.createDataFrame(rows, "seq int, field_id string, prediction struct<field_id: string>, trace_id string, id string, run_id string")
    assert {r.field_id: r.trace_id for r in proofs.trace_index(events, ["seq"]).collect()} == {"f": "i2", "g": "r3", "h": "t4"}
    assert {r.field_id: r.trace_id for r in proofs.trace_index(events.select("seq", "field_id", "run_id"), ["seq"]).collect()} == {"f": "r", "g": "r3"}
    asked = spark.createDataFrame([("f", 1), ("f", 9), ("g", 2), ("z", 5)], "field_id string, seq int").withColumn("trace_id", F.lit("old"))
    assert {(r.field_id, r.seq): r.trace_id for r in proofs.traced_at(asked, events, "seq", 2).collect()} == {("f", 1): "t1", ("f", 9): "i2", ("g", 2): None, ("z", 5): None}


def test_every_comment_holds_its_own_trace(spark):
    events = spark.createDataFrame([(1, "a", "ta"), (2, "b", "tb")], "seq int, field_id string, trace_id string")
    rows = [("a", 1, "A1", "answered", 0.5, ["c1"], [], None), ("b", 1, "A2", "not_found", 0.1, [], [], None), ("c", 1, "A3", "answered", 0.9, [], [], None)]
    told = spark.createDataFrame(rows, PREDICTED).withColumns({"validation_pass": F.lit(True), "evidence_missing": F.lit(False), "violations": F.array().cast("array<string>")})
    acted = writeback.actions(writeback.targets(told, "S"))
    audit = writeback.commented(proofs.traced(acted, proofs.trace_index(events, ["seq"])))
    assert {r.field_id: r.comment.rpartition("trace_id: ")[2] for r in audit.collect()} == {"a": "ta", "b": "tb", "c": ""}
    assert [(r.field_id, r.reason, r.trace_id) for r in proofs.review_items(audit).collect()] == [("b", "skipped_status", "tb")]


def test_evidence_map(spark):
    rows = [("a", 1, "A1", "answered", 0.5, ["c1"], ["x"], "t"), ("a", 2, "A2", "not_found", None, None, [], None), ("b", 1, None, None, None, None, None, None)]
    earlier = [("a", 0, "Z1", "answered", 0.9, [], [], "old"), ("z", 0, "Z2", "answered", 0.9, ["k"], [], "old")]
    got = {r.field_id: tuple(r)[1:] for r in proofs.evidence_map(spark.createDataFrame(rows, PREDICTED), ["n"], spark.createDataFrame(earlier, PREDICTED)).collect()}
    assert got == {"a": ("A2", "not_found", None, None, [], None), "b": (None,) * 6, "z": ("Z2", "answered", 0.9, ["k"], [], "old")}
    assert proofs.evidence_map(spark.createDataFrame([], PREDICTED), ["n"]).count() == 0


def test_citations(spark):
    hits = [("q1", 1, "c1", "f.xlsx", "S!A1", "one"), ("q1", 2, "c2", "", None, " two  words "), ("q1", 3, "c2", "g.docx", "", "last"), ("q1", 4, "c3", None, "", ""), ("q2", 2, "c9", "z", "a", "b"), ("q2", 1, "c8", "best", None, "hit"), ("q5", 1, "c1", "own", None, None)]
    one = ("f", "", "why")
    answers = [("q1", None, ["c2", "c1", "nope", "c2", "c3"]), ("q2", [], ["c1"]), ("q3", [one, None, ("g", "B2", None), ("late", None, None)], ["c1"]), ("q4", None, None), ("q5", [("", None, "")], ["c1"])]
    got = proofs.citations(spark.createDataFrame(answers, "query_id string, references array<struct<file_name: string, anchor: string, reason: string>>, source_chunk_ids array<string>"), spark.createDataFrame(hits, "query_id string, rank int, chunk_id string, file_name string, anchor string, raw_text string"))
    assert {r.query_id: (r.source, r.n_cited, r.summary) for r in got.collect()} == {
        "q1": ("chunks", 3, "g.docx / last；f.xlsx / S!A1 / one；g.docx / last"), "q2": ("best_hit", 0, "best / hit"), "q3": ("references", 2, "f / why；g / B2"), "q4": ("none", 0, ""), "q5": ("references", 1, ""),
    }
