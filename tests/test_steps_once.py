"""Decisions, validation and metrics: what they share is made once, and the results are those of plain Python."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F
from sheafline.functions import text as T
from sheafline.operators import evidence, metrics

CANDIDATE = "field_id string, field_type string, target string, chunk_id string, namespace string, source_type string, answer_value string, answer_status string, score double"
FIELD = "field_id string, field_type string, required boolean, must_have_evidence boolean, regex string, option_values array<string>, aliases array<string>, min double, max double"
GOLD = "field_id string, expected_value string, expected_status string, aliases array<string>, field_type string, required boolean, must_have_evidence boolean, gold_ids array<string>, regex string, options array<string>, min double, max double"
PREDICTION = "field_id string, ordinal int, answer_value string, answer_status string, confidence double, source_ids array<string>"


def arrow_steps(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def decided(rows):
    """The rules of ``select_evidence`` for one field, in Python; no answer here is uncertain but 可能."""
    place = lambda r: (1 if r[5] == evidence.MAIN else 2 if r[5] == evidence.EMBEDDED else 4 if r[5] == evidence.INTRO else 3) if r[4] == "T" else 5 if r[5] == evidence.INTRO else 6
    truth = {"是": "是", "yes": "是", "无": "否"}
    own = [r for r in rows if r[4] == "T"]
    good = [r for r in own if r[7] == "answered" and r[6] not in (None, " ", evidence.NOT_FOUND)]
    if not own:
        return "clue_only", None, sorted({r[3] for r in rows})
    for p in (1, 2, 3, 4):
        if len({truth.get(r[6], r[6]) for r in good if place(r) == p}) > 1:
            return "conflict_unresolved", None, sorted({r[3] for r in own if place(r) == p})
    least = lambda some: min(some, key=lambda r: (place(r), -r[8], r[3]), default=None)
    sure = lambda r: r[6] != "可能"
    pick, explicit, main = least([r for r in good if sure(r)]), least([r for r in good if place(r) == 2 and r[6] in truth]), [r for r in good if place(r) == 1]
    if rows[0][1] == "bool" and main and not any(map(sure, main)) and explicit:
        pick = explicit
    return ("use_direct_evidence", pick[3], []) if pick else ("no_evidence", None, [])


def test_decisions_match_plain_rules(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        answers = rng.choice([["是", "yes"], ["A", "可能", "无"], ["是", "无", "A"], [None, " ", evidence.NOT_FOUND, "A"]])
        for j in range(rng.randint(1, 5)):
            kind = rng.choice([evidence.MAIN, evidence.EMBEDDED, evidence.INTRO, "other"])
            rows.append((f"f{i}", ("text", "bool")[i % 2], "T", f"c{i}-{j}", rng.choice("TTTG"), kind, rng.choice(answers), rng.choice(["answered", "answered", "not_found"]), float(rng.randint(0, 2))))
    got = {r.field_id: (r.decision, r.chunk and r.chunk.chunk_id, r.chunk_ids) for r in evidence.select_evidence(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {f: decided([r for r in rows if r[0] == f]) for f in {r[0] for r in rows}}
    assert {d for d, _, _ in got.values()} == set(evidence.DECISIONS)


def test_run_reads_candidates_once(spark):
    """One Arrow step for the candidates and one for repaired answers; before, two for each. (Fields of type date take one more.)"""
    fields = spark.createDataFrame([("a", "text", True, True, "", [], [], None, None)], FIELD).withColumns({"field_type": F.lit("text"), "option_values": F.array().cast("array<string>"), "aliases": F.array().cast("array<string>")})
    found = spark.createDataFrame([("a", "text", "T", "c", "T", evidence.MAIN, "A", "answered", 1.0)], CANDIDATE)
    summary = evidence.trace_summary(evidence.trace(evidence.run_fields(fields, found), "r"))
    assert arrow_steps(summary) == 2 and summary.first()[:] == (7, 1, 1, 1, 0, 0)


def test_white_space_of_every_character(spark):
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    rows = spark.createDataFrame([(m, f" a{m}b{m}", unicodedata.normalize("NFKC", f" a{m}b{m}").casefold()) for m in marks], "m string, v string, folded string")
    assert rows.where(~T.normalize_text(F.col("v")).eqNullSafe(T.collapse(F.col("folded")))).collect() == []


def test_badcases_make_metrics_once(spark):
    """One Arrow step for all metrics of a row, and texts normalised there; before, two, and ten times as many patterns in the plan."""
    golds = spark.createDataFrame([("a", "12 kW", "answered", [], "number", True, True, ["s"], "", [], 1.0, 20.0), ("b", "x", "answered", [], "text", True, True, ["s"], "", [], None, None)], GOLD)
    told = spark.createDataFrame([("a", 1, "12000 W", "answered", 0.9, ["s"]), ("b", 1, "y", "answered", 0.9, [])], PREDICTION)
    counts = metrics.badcase_counts(metrics.evaluate(golds, told))
    assert arrow_steps(counts) == 1 and len(re.findall("regexp_(?:replace|extract)", counts._jdf.queryExecution().executedPlan().toString())) < 100
    assert {r.badcase: r.n for r in counts.collect()} == {"exact_mismatch": 2, "semantic_mismatch": 1, "evidence_missing": 1, "evidence_low_recall": 1, "needs_human_review": 1, "correction_required": 1}
