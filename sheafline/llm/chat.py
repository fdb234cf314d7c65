"""Tool-call linking for chat records, in DataFrame functions only.

Messages of role ``assistant`` may hold tool calls, as JSON ``{"tool_calls": [{"id", "name", "arguments", "after":
[ids]}]}``, or with name and arguments inside ``"function"``; messages of role ``tool`` hold results, as JSON
``{"tool_call_id", "content"}``. Arguments are a JSON object, or a string that holds one. Calls and results are joined
by conversation and identifier, arguments are held against schemas, and calls are put in a topological order of what
they come after. Joins and groups are by conversation *and* identifier, so a conversation of any length is dealt out
to many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CALLS = "tool_calls array<struct<id string, name string, arguments string, after array<string>, function struct<name string, arguments string>>>"
RESULT = "tool_call_id string, content string"
#: Names of argument types, and the pattern of what Spark calls a JSON value of each.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL.*|FLOAT|DOUBLE", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def parsed(text: Column) -> Column:
    """A JSON object as variant; null where the text holds none, or one that names a key twice."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def calls_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, call_id, name, arguments, after`` of every tool call with an id; other texts hold none.

    ``arguments`` is JSON text as it stands in the message; ``{}`` where there is none.
    """
    rows = messages.where("role = 'assistant' and text rlike '^[ \\t\\r\\n]*[{]'").select("conv_id", "turn", F.from_json("text", CALLS).alias("m"))
    rows = rows.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("pos", "c"))
    named, given = F.coalesce("c.name", "c.function.name"), F.coalesce("c.arguments", "c.function.arguments", F.lit("{}"))
    return rows.select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), named.alias("name"), given.alias("arguments"), F.coalesce(F.col("c.after"), F.array().cast("array<string>")).alias("after")).where("call_id is not null")


def results_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, call_id, content`` of every result with an id."""
    rows = messages.where("role = 'tool' and text rlike '^[ \\t\\r\\n]*[{]'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return rows.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).where("call_id is not null")


def violations(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``errors``, a sorted array: ``unknown_tool``, ``malformed``, ``missing:p``, ``type:p``, ``range:p`` and ``extra:p``.

    Types are those of the JSON value: ``"7"`` is a string, 7 and 7.0 are integers, all numbers are of type number; a
    parameter without a known type takes any value. Lengths bind strings only. Arguments that are no JSON object, or
    name a key twice, are malformed, which is then the only error. ``schemas(tool, param, type, required, min_length,
    max_length)`` has a row for each parameter; a tool without parameters has one of null. It is a table of tools, not
    of data: one row for each call is joined with its tool's parameters as one array.
    """
    tools = schemas.groupBy("tool").agg(F.collect_list(F.struct("param", "type", "required", "min_length", "max_length")).alias("params"))
    joined = calls.join(tools, calls["name"] == tools["tool"], "left").withColumn("given", parsed(F.col("arguments")).cast("map<string,variant>"))

    def fault(p: Column) -> Column:
        value = F.try_element_at(F.col("given"), p["param"])
        kind = F.schema_of_variant(value)
        typed = reduce(lambda x, t: x.when(p["type"] == t[0], kind.rlike(f"^(?:{t[1]})$")), TYPES.items(), F.when(p["type"].isNull(), F.lit(True))).otherwise(F.lit(True))
        length = F.when(kind == "STRING", F.length(value.cast("string")))
        outside = F.coalesce(length < p["min_length"], F.lit(False)) | F.coalesce(length > p["max_length"], F.lit(False))
        return (
            F.when(p["param"].isNull(), F.lit(None).cast("string"))
            .when(~F.map_contains_key("given", p["param"]), F.when(p["required"], F.concat(F.lit("missing:"), p["param"])))
            .when(~typed, F.concat(F.lit("type:"), p["param"]))
            .when(outside, F.concat(F.lit("range:"), p["param"]))
        )

    named = F.array_compact(F.transform("params", lambda p: p["param"]))
    extra = F.transform(F.array_except(F.map_keys("given"), named), lambda k: F.concat(F.lit("extra:"), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform("params", fault)), extra))
    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown_tool"))).when(F.col("given").isNull(), F.array(F.lit("malformed"))).otherwise(found)
    return joined.withColumn("errors", errors).drop("tool", "params", "given")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 for calls that come after nothing, else one more than the highest before them; null in a cycle.

    ``calls(conv_id, turn, pos, call_id, after)``, call_id once in a conversation. Names of calls that don't exist
    bind nothing. Most transcripts name earlier calls only, but a chain can be as long as its conversation, so
    levels are not walked one at a time: chains, where each call comes after one other at most, are ranked by
    pointer doubling, in as many rounds as the logarithm of their length. Calls that come after several are then
    settled round by round; their rounds are as many as such calls follow one another, and each reads only what is
    still waiting and what the round before has settled.
    """
    nodes = calls.select("conv_id", "call_id")
    named = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
    there = nodes.withColumnRenamed("call_id", "before")
    edges = materialise(named.join(there, ["conv_id", "before"]).select("conv_id", "call_id", "before"))
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0).cast("long"))
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    # up: the call to which a chain leads back, and by how many steps; a call with none or several ends its chain
    state = materialise(nodes.join(degree, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("before")).alias("up"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("steps")))
    for _ in range(state.count().bit_length() + 1):  # a chain that still moves then is in a cycle
        over = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        jumped = state.select("conv_id", "call_id", "n", "up", "steps").join(over, ["conv_id", "up"], "left")
        moves = F.col("next").isNotNull()
        state = materialise(jumped.select("conv_id", "call_id", "n", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.when(moves, F.col("more")).otherwise(0)).alias("steps"), moves.alias("moved")))
        if state.where("moved").isEmpty():
            break
    ends = state.select("conv_id", "call_id", "n", F.coalesce("up", "call_id").alias("end"), "steps")
    heads = ends.where("n != 1").select("conv_id", F.col("call_id").alias("end"), F.col("n").alias("end_n"))
    ranked = materialise(ends.join(heads, ["conv_id", "end"], "left"))  # end_n is null in a cycle
    known = ranked.where("end_n = 0").select("conv_id", "call_id", F.col("steps").alias("level"))
    waiting = ranked.where("end_n > 1").select("conv_id", "call_id", "end", "steps")
    if waiting.isEmpty():
        return nodes.join(known, ["conv_id", "call_id"], "left")
    open_calls = materialise(waiting.where("call_id = end").join(degree, ["conv_id", "call_id"]).select("conv_id", "call_id", "n", F.lit(0).cast("long").alias("top")))
    into = materialise(edges.join(open_calls.select("conv_id", "call_id"), ["conv_id", "call_id"]))
    settled = [known]
    while True:
        before = settled[-1].select("conv_id", F.col("call_id").alias("before"), "level")
        came = into.join(before, ["conv_id", "before"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("m"), F.max("level").alias("highest"))
        open_calls = materialise(open_calls.where("n > 0").join(came, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), F.greatest("top", "highest").alias("top")))
        ready = open_calls.where("n = 0").select("conv_id", F.col("call_id").alias("end"), (F.col("top") + 1).alias("base"))
        if ready.isEmpty():
            return nodes.join(reduce(DataFrame.unionByName, settled), ["conv_id", "call_id"], "left")
        settled.append(materialise(waiting.join(ready, ["conv_id", "end"]).select("conv_id", "call_id", (F.col("base") + F.col("steps")).alias("level"))))


def canonical(arguments: Column) -> Column:
    """JSON text of an object in canonical form: keys sorted at every depth, no white space, no zeros that end a decimal.

    What is no JSON object, or names a key twice, is written as one JSON string. Of numbers only those beyond 38
    digits are written with an exponent.
    """
    return F.coalesce(F.to_json(parsed(arguments)), F.regexp_replace(F.to_json(F.array(arguments)), r"^\[|\]$", ""))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each tool call and each result without a call of ``messages(conv_id, turn, role, text)``.

    Returns conv_id, call_id, call_turn, result_turn, level, status, errors (joined by a space), record. status:
    ``answered``, ``unanswered``, ``orphan`` (a result without a call). Of calls that repeat an id in a conversation
    the first by turn and place counts, and the same of results; ``n_calls`` and ``n_results`` tell how many there
    were. ``record`` is canonical JSON: sorted keys, no white space, arguments as the object they are. Sorting by conv_id,
    level, call_turn and call_id gives a topological order; level is null for orphans and in cycles. Null texts,
    texts that are no JSON and rows without conv_id hold nothing; other columns are ignored; an empty table gives
    an empty table.
    """
    rows = messages.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    first = F.struct("turn", "pos", "name", "arguments", "after")
    calls = calls_of(rows).groupBy("conv_id", "call_id").agg(F.min(first).alias("c"), F.count("*").alias("n_calls"))
    calls = materialise(calls.select("conv_id", "call_id", "n_calls", "c.turn", "c.pos", "c.name", "c.arguments", "c.after"))
    results = results_of(rows).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    results = results.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    checked = violations(calls.join(levels(calls), ["conv_id", "call_id"], "left"), schemas)
    joined = checked.join(results, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    # each field is JSON with its key, in the order of keys; those of null are left out
    texts = [F.regexp_replace(F.to_json(F.struct(c.alias(k))), r"^\{|\}$", "") for k, c in (("content", F.col("content")), ("id", F.col("call_id")), ("name", F.col("name")), ("status", status))]
    fields = [F.concat(F.lit('"arguments":'), canonical(F.col("arguments"))), *(F.when(t != "", t) for t in texts)]
    return joined.select(
        "conv_id", "call_id", F.col("turn").alias("call_turn"), "result_turn", F.col("level").cast("long").alias("level"), status.alias("status"),
        F.coalesce(F.array_join("errors", " "), F.lit("")).alias("errors"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("record"),
    )


#: The tool that ``as_tool_messages`` makes of an exchange: (tool, param, type, required, min_length, max_length).
EXCHANGE_SCHEMA = (("reply", "text", "string", True, 1, 1000), ("reply", "turn", "integer", True, 1, None))


def exchange_schema(spark) -> DataFrame:
    """EXCHANGE_SCHEMA as a table."""
    kinds = ("string", "string", "string", "boolean", "int", "int")
    names = ("tool", "param", "type", "required", "min_length", "max_length")
    rows = [F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, names, strict=True)]) for row in EXCHANGE_SCHEMA]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """The exchanges of ``conversations(conv_id, turn, role, text)`` as tool messages.

    A user's turn becomes a call of ``reply`` with the id ``c<turn>``, after the call two turns before; an assistant's
    turn becomes the result of the turn before it. Other roles are dropped.
    """
    turn = F.col("turn").cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), turn).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("text"), F.col("turn").cast("long").alias("turn")).alias("arguments"), F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), text.alias("content")))
    rows = conversations.where("role in ('user', 'assistant') and turn is not null")
    is_call = F.col("role") == "user"
    return rows.select("conv_id", "turn", F.when(is_call, "assistant").otherwise("tool").alias("role"), F.when(is_call, call).otherwise(result).alias("text"))
