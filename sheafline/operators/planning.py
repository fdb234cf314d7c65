"""Query plans of fields, and the candidates that a field's question or id finds among chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .evidence import EMBEDDED, MAIN
from .order import first_match
from .retrieval import HITS, Layer, Plan, _Matcher, _query_blocks, _running

#: Fixed values: (intent, words of a question, other names to search by); the first whose words occur is the intent, all add their names.
INTENTS = (
    ("power_supply", "市电|供电|双路", ("双路市电", "两路供电", "供电能力")),
    ("ups", "(?i)ups", ("不间断电源", "UPS容量", "后备电源")),
    ("access_control", "门禁", ("门禁系统", "出入控制", "门禁配置")),
    ("room_identity", "机房名称", ("机房", "房间名称", "机房编号")),
    ("inspection", "日期|巡检", ("巡检时间", "检查日期", "最近巡检")),
)
#: Delimiters of question tokens.
DELIMITERS = r"[\s,，;；:：/()（）]+"


def query_plans(fields: DataFrame, target: str, context: str | None = None, global_namespace: str = "global") -> DataFrame:
    """``fields(field_id, question_text, aliases, ...)`` with intent, primary_query, fallback_queries and fallback_namespaces."""
    question = F.coalesce("question_text", F.lit(""))
    none = F.array().cast("array<string>")
    names = F.flatten(F.array(*[F.when(question.rlike(p), F.array(*[F.lit(x) for x in more])).otherwise(none) for _, p, more in INTENTS]))
    parts = F.concat(F.array(F.lit(target), F.lit(context or ""), question), F.coalesce("aliases", none), names)
    return fields.withColumns({
        "intent": first_match([(question.rlike(p), i) for i, p, _ in INTENTS], "general"), "target_namespace": F.lit(target),
        "primary_query": F.array_join(F.filter(parts, lambda p: p != ""), " "), "fallback_queries": F.array_distinct(F.filter(F.concat(F.array(question), names), lambda p: p != "")), "fallback_namespaces": F.array(F.lit(global_namespace)),
    })


def mini_candidates(plans: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """``field_id, chunk_id, score``: chunks of the field's id (0.5), or that hold the question or one of its tokens (0.2).

    Chunks of the target namespace add 0.3, main rows 0.2, embedded tables 0.15. ``plans(query_id, field_id,
    question_text, target_namespace)``, ``chunks(chunk_id, field_id, text, question_text, answer_value, namespace,
    source_type)``. Ids are joined; texts are searched once for the tokens of all questions of a block, and what is
    found is scored there. With ``k`` only the best of each question stay, ties by chunk id; then a task yields no more than
    ``k`` rows a question, however many chunks it reads.
    """
    kinds = {MAIN: 0.2, EMBEDDED: 0.15}
    bonus = F.when(F.col("namespace") == F.col("target_namespace"), 0.3).otherwise(0.0) + first_match([(F.col("source_type") == t, v) for t, v in kinds.items()], 0.0)
    own = plans.select("query_id", "field_id", "target_namespace").join(chunks.select("field_id", F.col("chunk_id").cast("long").alias("chunk_id"), "namespace", "source_type"), "field_id")
    found = own.select("query_id", "chunk_id", (F.lit(0.5) + bonus).alias("score"))
    tokens = F.filter(F.concat(F.array(F.coalesce("question_text", F.lit(""))), F.split("question_text", DELIMITERS)), lambda t: F.length(t) >= 2)
    asked = plans.select("query_id", "target_namespace", tokens.alias("tokens"))
    stack = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.concat_ws(" ", "question_text", "text", "answer_value").alias("stack"), F.col("namespace").cast("string").alias("namespace"), F.col("source_type").cast("string").alias("source_type"))
    for block in _query_blocks(asked, ["query_id", "target_namespace", "tokens"]):
        sent = chunks.sparkSession.sparkContext.broadcast([(r["query_id"], r["target_namespace"], r["tokens"] or []) for r in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _Matcher([(q, t) for q, _, t in sent.value])
            ids, targets = np.array([q for q, _, _ in sent.value], np.int64), np.array([n for _, n, _ in sent.value], object)

            def scored(part: pa.RecordBatch) -> pa.RecordBatch:
                hits = [np.flatnonzero(matcher.scores(text)) for text in part["stack"].to_pylist()]
                at, row = np.concatenate(hits), np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                names, more = np.array(part["namespace"].to_pylist(), object)[row], np.array([kinds.get(t, 0.0) for t in part["source_type"].to_pylist()])[row]
                same = np.array([n is not None and n == t for n, t in zip(names, targets[at], strict=True)], bool)
                score = 0.2 + (np.where(same, 0.3, 0.0) + more)
                return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(np.zeros(len(at), np.int32)), pa.array(part["chunk_id"].to_numpy(zero_copy_only=False)[row], pa.int64()), pa.array(score, pa.float64())], ["query_id", "layer", "chunk_id", "score"])

            parts = (scored(batch.slice(i, 2048)) for batch in batches for i in range(0, batch.num_rows, 2048))
            some = (part for part in parts if part.num_rows)
            yield from some if k is None else _running(some, Plan(layers=(Layer("coarse", top_k=k),)))

        found = found.unionByName(stack.mapInArrow(run, HITS).drop("layer"))
    best = found.groupBy("query_id", "chunk_id").agg(F.bround(F.max("score"), 6).alias("score"))
    if k is not None:
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("place") <= k)
    return best.join(plans.select("query_id", "field_id"), "query_id").select("field_id", "chunk_id", "score")
