"""Plans, candidates, service ports, redaction and settings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from sheafline import config
from sheafline.functions.redact import redacted
from sheafline.operators import evidence, planning, services


def test_plans_and_candidates(spark):
    fields = spark.createDataFrame([(1, "f1", "UPS 日期", ["a"]), (2, "f2", "门禁", []), (3, "f3", None, None)], "query_id long, field_id string, question_text string, aliases array<string>")
    plans = planning.query_plans(fields, "east", "room")
    got = {r.field_id: r for r in plans.collect()}
    assert (got["f1"].intent, got["f2"].intent, got["f3"].intent) == ("ups", "access_control", "general")
    assert got["f1"].primary_query.startswith("east room UPS 日期 a 不间断电源") and got["f3"].fallback_queries == []
    chunks = spark.createDataFrame([(10, "f1", "other", None, "v", "east", evidence.MAIN), (11, None, "the UPS", None, "v", "west", evidence.EMBEDDED), (12, None, "none", "门禁", "v", "east", "x"), (13, None, "zzz", None, "v", "east", "x")], "chunk_id long, field_id string, text string, question_text string, answer_value string, namespace string, source_type string")
    scores = {(r.field_id, r.chunk_id): r.score for r in planning.mini_candidates(plans, chunks).collect()}
    assert scores == {("f1", 10): 1.0, ("f1", 11): 0.35, ("f2", 12): 0.5}


def test_best_candidates(spark):
    """The best ``k`` of all candidates, ties by chunk id, over chunks in many batches; repeated chunks count once."""
    plans = spark.createDataFrame([(q, f"f{q}", f"w{q} w{q + 1}", "east") for q in range(6)] + [(9, "f9", None, None)], "query_id long, field_id string, question_text string, target_namespace string")
    kinds, spaces = [evidence.MAIN, evidence.EMBEDDED, "x", None], ["east", "west", None]
    rows = [(i, f"f{i % 40}", f"w{i % 9} and", None, None, spaces[i % 3], kinds[i % 4]) for i in range(900)]
    schema = "chunk_id long, field_id string, text string, question_text string, answer_value string, namespace string, source_type string"
    chunks = spark.createDataFrame(rows + rows[:5], schema).repartition(5)
    found = lambda k: [tuple(r) for r in planning.mini_candidates(plans, chunks, k).collect()]
    every = found(None)
    want = {(f"f{q}", i): (0.5 if field == f"f{q}" else 0.2) + 0.3 * (space == "east" and q < 9) + {evidence.MAIN: 0.2, evidence.EMBEDDED: 0.15}.get(kind, 0) for q in (*range(6), 9) for i, field, text, _, _, space, kind in rows if field == f"f{q}" or (q < 9 and text.split()[0] in (f"w{q}", f"w{q + 1}"))}
    assert len(every) == len(want) and {(f, i): s for f, i, s in every} == {c: round(s, 6) for c, s in want.items()}
    for k in (1, 30):
        best = sorted(x for f in {f for f, _, _ in every} for x in sorted((r for r in every if r[0] == f), key=lambda r: (-r[2], r[1]))[:k])
        assert sorted(found(k)) == best
    assert planning.mini_candidates(plans, chunks.where("false")).count() == 0


def test_cached_calls(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad")], "id long, prompt string")
    cache = prompts.where("id = 2").select(services.prompt_key("m", F.col("prompt")).alias("prompt_key"), F.lit("old").alias("response"))

    def generator(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    got = {r.id: (r.response, r.cached, r.error) for r in services.ask(prompts, generator, "m", cache, batch=1).collect()}
    assert got == {1: ("A", False, None), 2: ("old", True, None), 3: ("A", False, None), 4: (None, False, "RuntimeError('down')")}


def test_hints(spark):
    good = {"table_type": "t", "header_rows": [1], "data_rows": [2, 3], "column_headers": ["a"], "row_strategy": "s", "confidence": 0.5}
    rows = [(1, "```json\n" + json.dumps(good) + "\n```"), (2, "see: " + json.dumps(good | {"data_rows": [9], "confidence": 2}) + " ok"), (3, "nothing"), (4, json.dumps({"table_type": "t"})), (5, None)]
    answers = spark.createDataFrame(rows, "id long, response string").withColumn("available_rows", F.array(*[F.lit(i) for i in (1, 2, 3)]))
    got = {r.id: (r.status, r.errors) for r in services.checked_hints(answers).collect()}
    assert got[1] == ("valid", []) and got[2] == ("invalid", ["data_rows contains unknown rows", "confidence must be between 0 and 1"])
    assert got[3][0] == got[5][0] == "invalid_json" and got[4][0] == "invalid" and "missing confidence" in got[4][1]


def test_closed_book(spark):
    items = spark.createDataFrame([(1, "q1", "blue"), (2, "q2", "red")], "query_id long, query string, heldout string")
    hits = spark.createDataFrame([(1, 2, "sea"), (1, 1, "blue sky")], "query_id long, rank int, text string")

    def answer(prompts):
        assert not any("red" in p for p in prompts)
        return ["blue" if "blue" in p else "未找到" for p in prompts]

    def judge(prompts):
        return [json.dumps({"label": "exact", "score": 1.0} if (d := json.loads(p))["answer"] == d["heldout"] else {"label": "wrong", "score": 0}) for p in prompts]

    summary = services.judged_summary(services.closed_book(items, hits, answer, judge)).first()
    assert tuple(summary) == (2, 0.5, 1, 1)


def test_redaction(spark):
    payload = {"API_KEY": "k", "a": [{"password2": 1, "text": "x " * 200}], "n": 1.5}
    out = [r[0] for r in spark.createDataFrame([(json.dumps(payload),), ("no json",), (None,)], "p string").select(redacted("p")).collect()]
    clean = json.loads(out[0])
    assert clean["API_KEY"] == "[redacted]" and clean["a"][0]["password2"] == "[redacted]" and clean["n"] == 1.5 and len(clean["a"][0]["text"]) == 162
    assert out[1:] == ["no json", None]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("retrieval:\n  vector_top_k: 7\n  query_layers: [fact]\nagent:\n  confidence_threshold: 0.5\n")
    got = config.load(str(tmp_path / "c.yaml"), {"SHEAFLINE__AGENT__CONFIDENCE_THRESHOLD": "0.6", "SHEAFLINE__RETRIEVAL__VECTOR_TOP_K": "8", "OTHER": "1"}, {"retrieval": {"vector_top_k": 9, "nope": 1}})
    assert (got.retrieval.vector_top_k, got.retrieval.query_layers, got.agent.confidence_threshold, got.writeback.mode) == (9, ("fact",), 0.6, "safe")
