"""Comparison of five answering methods over the same fields and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .evidence import CONSTRAINTS, EMBEDDED, INTRO, MAIN, NOT_FOUND, constraint_violations
from .order import first_match
from .retrieval import Layer, Plan, fixed_chunks, flat_topk, lexical_topk

NAIVE, FLAT, LAYERED, VALIDATED, REPAIRED = metrics.METHODS
#: Parts of one chunk in the naive method, at most; their ids are made of both numbers.
PARTS = 1 << 20


def default_plan(k: int) -> tuple[Layer, ...]:
    """Target main rows, target embedded tables, common facts and introductions; all that a final cut at ``k`` can need."""
    most = 3 * k
    return (Layer("main", "target", ("fact", "evidence"), (MAIN,), most), Layer("embedded", "target", ("fact",), (EMBEDDED, "embedded_raw_segment"), most), Layer("common", "global", ("fact", "intro_doc"), (INTRO, "mini_fact"), most))


def candidates(method: str, golds: DataFrame, chunks: DataFrame, k: int = 10, chunk_chars: int = 80, layers: Sequence[Layer] | None = None, global_namespace: str = "global") -> DataFrame:
    """``field_id, rank, chunk_id, answer_value, answer_status, source_ids`` that the method retrieves for each field.

    ``golds(query_id, query, namespace, field_id)``, ``chunks(chunk_id, text, namespace, corpus_layer, source_type,
    answer_value, answer_status, source_ids)``; chunk_id is the chunk's place. The naive method searches pieces of
    fixed size in every namespace and knows no sources.
    """
    told = chunks.select("chunk_id", "answer_value", "answer_status", "source_ids")
    if method == NAIVE:
        pieces = fixed_chunks(chunks, chunk_chars, "chunk_id").select((F.col("chunk_id") * PARTS + F.col("part")).alias("chunk_id"), F.col("chunk_text").alias("text"))
        hits = lexical_topk(golds, pieces, Plan(layers=(Layer("all", top_k=k),))).withColumn("chunk_id", F.floor(F.col("chunk_id") / PARTS))
        told = told.withColumn("source_ids", F.array().cast("array<string>"))
    elif method == FLAT:
        hits = flat_topk(golds, chunks, k, global_namespace=global_namespace)
    else:
        hits = lexical_topk(golds, chunks, Plan(layers=tuple(layers or default_plan(k)), global_namespace=global_namespace)).where(F.col("rank") <= k)
    return hits.join(golds.select("query_id", "field_id"), "query_id").join(told, "chunk_id").select("field_id", "rank", "chunk_id", "answer_value", "answer_status", "source_ids")


def predict(method: str, golds: DataFrame, found: DataFrame, repairs: int = 1) -> DataFrame:
    """``field_id, ordinal, answer_value, answer_status, confidence, source_ids, cost, latency_ms`` for every gold field.

    The first candidate answers with confidence 0.72. The validating methods withhold an answer that breaks a
    constraint or lacks evidence; the repairing one then takes the first of ``repairs + 1`` candidates that passes.
    """
    rows = found.join(golds.select("field_id", "must_have_evidence", *[c for c in CONSTRAINTS if not c.startswith("answer_")]), "field_id")
    lacks = F.col("must_have_evidence") & (F.col("answer_status") == "answered") & (F.size("source_ids") == 0)
    rows = rows.withColumn("failed", (F.size(constraint_violations({c: F.col(c) for c in CONSTRAINTS})) > 0) | lacks)
    row = F.struct("rank", "answer_value", "answer_status", "source_ids", "failed")
    good = ~F.col("failed") & (F.col("answer_status") == "answered") & (F.col("rank") <= repairs + 1)
    best = rows.groupBy("field_id").agg(F.min_by(row, "rank").alias("first"), F.min_by(F.when(good, row), F.when(good, F.col("rank"))).alias("passing"))
    joined = golds.select("field_id").join(best, "field_id", "left")
    pick = F.when(F.col("passing").isNotNull(), F.col("passing")).otherwise(F.col("first")) if method == REPAIRED else F.col("first")
    joined = joined.withColumn("c", pick)
    withheld = F.col("c.failed") if method in (VALIDATED, REPAIRED) else F.lit(False)
    none = F.col("c").isNull()
    seconds, cost = metrics.METHODS[method]
    blank = F.coalesce(F.col("c.answer_value"), F.lit("")).isin("", NOT_FOUND)
    return joined.select(
        "field_id", F.lit(0).alias("ordinal"), F.when(none | withheld, F.lit(NOT_FOUND)).otherwise(F.col("c.answer_value")).alias("answer_value"),
        first_match([(none, "not_found"), (withheld & blank, "not_found"), (withheld, "partial_clue")], F.col("c.answer_status")).alias("answer_status"),
        first_match([(none, 0.1), (withheld, 0.5), (F.col("c.rank") > 1, 0.82)], 0.72).alias("confidence"),
        F.when(none | withheld, F.array().cast("array<string>")).otherwise(F.col("c.source_ids")).alias("source_ids"), F.lit(cost).alias("cost"), F.lit(seconds).alias("latency_ms"),
    )


def compare(golds: DataFrame, chunks: DataFrame, methods: Sequence[str] = tuple(metrics.METHODS), k: int = 10, chunk_chars: int = 80) -> DataFrame:
    """Metric rows of every method: ``method`` and the columns of ``metrics.evaluate``."""
    out = None
    for method in methods:
        told = predict(method, golds, candidates(method, golds, chunks, k, chunk_chars))
        rows = metrics.evaluate(golds.drop("query_id", "query", "namespace"), told).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out
