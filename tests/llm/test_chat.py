"""Tool-call linking against brute force."""

from __future__ import annotations

import json

from sheafline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level string, status string"
TOOLS = [("add", "a", "integer", True, None, None), ("add", "b", "number", True, None, None), ("say", "text", "string", False, 1, 5), ("ping", None, None, None, None, None)]


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": b} for i, n, a, b in calls]})


def run(spark, rows):
    messages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean, min_length int, max_length int")
    return {(r.conv_id, r.call_id): r for r in chat.link(messages, schemas).collect()}


def test_links_levels_and_errors(spark):
    chain = [(7, t, "assistant", call((f"k{t}", "ping", {}, [f"k{t - 1}"]))) for t in range(1, 50)] + [(7, 0, "assistant", call(("k0", "ping", {}, [])))]
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", call(("a", "add", {"b": 2.50, "a": 1}, []), ("b", "say", {"text": "too long"}, ["a"]))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": 'é "q"\n'})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
        (1, 4, "assistant", call(("c", "add", {"a": "1", "q": "1"}, ["a", "b"]), ("a", "ping", {}, []), ("d", "none", {}, ["gone"]))),
        (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "second"})), (1, 6, "assistant", call(("e", "ping", {}, ["c"]), ("f", "ping", {}, ["e", "d"]))),
        (2, 0, "assistant", call(("a", "ping", {}, ["b"]), ("b", "ping", {}, ["a"]), ("c", "ping", {}, ["a"]), ("s", "ping", {}, ["s"]))),
        (3, 0, "assistant", None), (3, 1, "tool", ""), (3, 2, "assistant", "{broken"), (3, 3, "assistant", "plain"), (None, 1, "assistant", call(("a", "ping", {}, []))),
        *chain,
    ]
    got = run(spark, rows)
    assert {k: v.level for k, v in got.items() if k[0] == 1} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "e"): 3, (1, "f"): 4, (1, "zz"): None}
    assert {k[1]: v.level for k, v in got.items() if k[0] == 2} == {"a": None, "b": None, "c": None, "s": None}
    assert {k[1]: v.level for k, v in got.items() if k[0] == 7} == {f"k{t}": t for t in range(50)}
    assert not [k for k in got if k[0] in (3, None)]
    a = got[1, "a"]
    assert (a.status, a.call_turn, a.result_turn, a.n_calls, a.n_results, a.errors) == ("answered", 1, 2, 2, 2, "")
    assert a.record == json.dumps({"arguments": {"a": 1, "b": 2.5}, "content": 'é "q"\n', "id": "a", "name": "add", "status": "answered"}, ensure_ascii=False, separators=(",", ":"))
    assert got[1, "b"].errors == "range:text" and got[1, "c"].errors == "extra:q missing:b type:a" and got[1, "d"].errors == "unknown_tool"
    assert got[1, "zz"].status == "orphan" and got[1, "b"].status == "unanswered"


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1, "user", "x")]) == {}


def test_exchanges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q" * 1200), (1, 2, "assistant", "r"), (1, 3, "user", None), (1, 6, "assistant", "o"), (1, 7, "user", "z")]
    messages = chat.as_tool_messages(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    schemas = spark.createDataFrame(chat.EXCHANGE_SCHEMA, "tool string, param string, type string, required boolean, min_length int, max_length int")
    got = {r.call_id: (r.level, r.status, r.errors) for r in chat.link(messages, schemas).collect()}
    assert got == {"c1": (0, "answered", "range:text"), "c3": (1, "unanswered", "range:text"), "c5": (None, "orphan", ""), "c7": (0, "unanswered", "")}


def raw(*calls):
    return '{"tool_calls": [' + ", ".join(calls) + "]}"


def test_types_forms_and_duplicate_keys(spark):
    kinds = [("t", "s", "string", True, 2, 4), ("t", "i", "integer", False, None, None), ("t", "n", "number", False, None, None), ("t", "b", "boolean", False, None, None), ("t", "l", "array", False, None, None), ("t", "o", "object", False, None, None), ("t", "z", "null", False, None, None), ("t", "any", None, False, None, None)]
    schemas = spark.createDataFrame(kinds, "tool string, param string, type string, required boolean, min_length int, max_length int")
    arguments = {
        "good": '{"s": "ab", "i": 7, "n": 1e2, "b": true, "l": [2, "x"], "o": {"y": {"d": 1, "c": 2.50}, "x": null}, "z": null, "any": []}',
        "whole": '{"s": "ab", "i": 7.0, "n": 12345678901234567890123}',
        "wrong": '{"s": 7, "i": "7", "n": "1", "b": "true", "l": {}, "o": [], "z": 0}',
        "half": '{"s": "ab", "i": 7.5}', "short": '{"s": "a"}', "long": '{"s": "abcde"}', "nothing": "{}", "none": '{"s": null}', "extra": '{"s": "ab", "q": 1, "": 2}',
        "twice": '{"s": "ab", "s": "cd"}', "deep": '{"s": "ab", "o": {"k": 1, "k": 2}}', "list": "[1]", "text": '"plain"',
    }
    calls = [f'{{"id": "{k}", "name": "t", "arguments": {a}}}' for k, a in arguments.items()]
    wire = json.dumps({"id": "wire", "type": "function", "function": {"name": "t", "arguments": '{"s": "\\u00e9\\n", "o": {"b": 1, "a": 2}}'}})
    rows = [(1, k, "assistant", " \n" + raw(c), "x", "y") for k, c in enumerate([*calls, wire, '{"id": "bare", "name": "t"}', '{"id": "huge", "name": "t", "arguments": {"s": "' + "x" * 300_000 + '"}}'])]
    got = {r.call_id: r for r in chat.link(spark.createDataFrame(rows, SCHEMA), schemas).collect()}
    assert {k: r.errors for k, r in got.items()} == {
        "good": "", "whole": "", "wrong": "type:b type:i type:l type:n type:o type:s type:z", "half": "type:i", "short": "range:s", "long": "range:s", "nothing": "missing:s",
        "none": "type:s", "extra": "extra: extra:q", "twice": "malformed", "deep": "malformed", "list": "malformed", "text": "malformed", "wire": "", "bare": "missing:s", "huge": "range:s",
    }
    assert got["good"].record == '{"arguments":{"any":[],"b":true,"i":7,"l":[2,"x"],"n":100,"o":{"x":null,"y":{"c":2.5,"d":1}},"s":"ab","z":null},"id":"good","name":"t","status":"unanswered"}'
    assert got["whole"].record == '{"arguments":{"i":7,"n":12345678901234567890123,"s":"ab"},"id":"whole","name":"t","status":"unanswered"}'
    assert json.loads(got["wire"].record)["arguments"] == {"o": {"a": 2, "b": 1}, "s": "é\n"}
    assert json.loads(got["twice"].record)["arguments"] == '{"s":"ab","s":"cd"}' and json.loads(got["text"].record)["arguments"] == "plain"
    assert len(got["huge"].record) > 300_000


def test_deep_levels_of_several_parents(spark):
    """A ladder in which each call comes after the two before it, and pairs that come after both of the pair before."""
    ladder = [(1, t, "assistant", call((f"k{t}", "ping", {}, [f"k{t - 1}", f"k{t - 2}"]))) for t in range(9)]
    pairs = [(2, t, "assistant", call(*((f"{side}{t}", "ping", {}, [f"a{t - 1}", f"b{t - 1}"]) for side in "ab"))) for t in range(5)]
    got = run(spark, ladder + pairs + [(3, 0, "assistant", call(("x", "ping", {}, ["y", "z"]), ("y", "ping", {}, []), ("z", "ping", {}, ["x"])))])
    assert {k: r.level for k, r in got.items() if k[0] == 1} == {(1, f"k{t}"): t for t in range(9)}
    assert {k: r.level for k, r in got.items() if k[0] == 2} == {(2, f"{side}{t}"): t for t in range(5) for side in "ab"}
    assert {k[1]: r.level for k, r in got.items() if k[0] == 3} == {"x": None, "y": 0, "z": None}


def test_sql_agrees(spark, sf_dir):
    import duckdb
    from sheafline.llm import oracles, queries

    got = queries.op8_tool_call_linking(spark, sf_dir).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    con.execute(oracles.ORACLES["op8_tool_call_linking"])
    names = [c[0] for c in con.description]
    assert len(got) and sorted(tuple(map(str, r)) for r in con.fetchall()) == sorted(tuple(str(r[n]) for n in names) for r in got)
