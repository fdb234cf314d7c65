"""Schemas of the JSON Lines files that the commands read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "field_id string, row_index int, target_cell string, question_text string, expected_value string, expected_status string, accepted_aliases array<string>, field_type string, required boolean, must_have_evidence boolean, gold_source_chunk_ids array<string>, constraints struct<enum_values: array<string>, regex: string, min: double, max: double>"
PREDICTION = "field_id string, row_index int, target_cell string, answer_value string, answer_status string, confidence double, source_chunk_ids array<string>, evidence_attachment_ids array<string>, validation struct<validation_pass: boolean, evidence_missing: boolean, constraint_violations: array<string>>, method_name string"
CHUNK = "chunk_id string, text string, namespace string, corpus_layer string, source_type string, field_id string, question_text string, answer_value string, answer_status string, source_chunk_ids array<string>, evidence_attachment_ids array<string>"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file with ``ordinal``, their order; these files are read in one piece only for that number's sake if they are small."""
    return spark.read.schema(schema).json(path).withColumn("ordinal", F.monotonically_increasing_id())


def golds(spark: SparkSession, path: str) -> DataFrame:
    """Gold fields, as ``metrics.evaluate`` and ``evidence.run_fields`` take them; missing keys get their defaults."""
    none, c = F.array().cast("array<string>"), F.col("constraints")
    rows = _lines(spark, path, GOLD)
    named = rows.select(
        "field_id", F.coalesce("question_text", F.lit("")).alias("question_text"), "target_cell", "expected_value", F.coalesce("expected_status", F.lit("answered")).alias("expected_status"), F.coalesce("accepted_aliases", none).alias("aliases"),
        F.coalesce("field_type", F.lit("text")).alias("field_type"), F.coalesce("required", F.lit(True)).alias("required"), F.coalesce("must_have_evidence", F.lit(True)).alias("must_have_evidence"), F.coalesce("gold_source_chunk_ids", none).alias("gold_ids"),
        F.coalesce(c["regex"], F.lit("")).alias("regex"), F.coalesce(c["enum_values"], none).alias("option_values"), c["min"].alias("min"), c["max"].alias("max"), F.col("ordinal").alias("query_id"),
    )
    return named


def predictions(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = _lines(spark, path, PREDICTION)
    return rows.select("field_id", "ordinal", "target_cell", "answer_value", F.coalesce("answer_status", F.lit("answered")).alias("answer_status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source_chunk_ids", none).alias("source_ids"), F.coalesce("evidence_attachment_ids", none).alias("evidence_attachment_ids"), F.col("validation.validation_pass").alias("validation_pass"), F.col("validation.evidence_missing").alias("evidence_missing"), F.col("validation.constraint_violations").alias("violations"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge chunks with their order as ``chunk_id`` and their own id as ``chunk_name``."""
    none = F.array().cast("array<string>")
    rows = _lines(spark, path, CHUNK)
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    sources = F.when(F.size(F.coalesce("source_chunk_ids", none)) > 0, F.col("source_chunk_ids")).otherwise(F.array("chunk_id"))
    return rows.select(F.col("ordinal").alias("chunk_id"), F.col("chunk_id").alias("chunk_name"), "text", default("namespace", "global"), default("corpus_layer", "fact"), default("source_type", "mini_fact"), "field_id", default("question_text", ""), "answer_value", default("answer_status", "answered"), sources.alias("source_ids"))
