"""Calls to model services behind ports: cached by prompt, resumable, answers parsed and checked as columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import first_match

HINT = "table_type string, header_rows array<int>, data_rows array<int>, title_rows array<int>, context_rows array<int>, group_rows array<int>, column_headers array<string>, row_strategy string, confidence double"
#: Keys that a structure hint must have, and its lists of rows.
REQUIRED = ("table_type", "header_rows", "data_rows", "column_headers", "row_strategy", "confidence")
ROW_LISTS = ("title_rows", "context_rows", "header_rows", "data_rows", "group_rows")
#: Labels of a judge, from best.
GOOD_LABELS, FAIR_LABELS = ("exact", "acceptable"), ("exact", "acceptable", "partial")


class Generator(Protocol):
    """Answers to prompts; called in tasks, a batch at a time. A raised error becomes the row's error."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def prompt_key(model: str, prompt: Column) -> Column:
    """16 hex digits that name a prompt of a model in the cache."""
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256), 1, 16)


def ask(prompts: DataFrame, generator: Generator, model: str, cache: DataFrame | None = None, batch: int = 16) -> DataFrame:
    """``prompts(prompt, ...)`` with prompt_key, response, error and cached. Prompts that repeat, or are cached, are asked once or not at all.

    ``cache(prompt_key, response)``. Append the rows that are new to the cache before the next run, and it resumes.
    """
    keyed = prompts.withColumn("prompt_key", prompt_key(model, F.col("prompt")))
    new = keyed.select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    known = None if cache is None else cache.groupBy("prompt_key").agg(F.min("response").alias("response"))
    if known is not None:
        new = new.join(known, "prompt_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                try:
                    answers, errors = list(generator(part["prompt"].to_pylist())), [None] * part.num_rows
                except Exception as e:  # a service's failure is a result of this row, not of the job
                    answers, errors = [None] * part.num_rows, [repr(e)] * part.num_rows
                yield pa.RecordBatch.from_arrays([part["prompt_key"], pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["prompt_key", "response", "error"])

    told = new.mapInArrow(run, "prompt_key string, response string, error string").withColumn("cached", F.lit(False))
    if known is not None:
        told = told.unionByName(known.select("prompt_key", "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")))
    return keyed.join(told, "prompt_key", "left")


def json_object(response: Column) -> Column:
    """The JSON object in a model's answer: without code fences, from the first brace to the last."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(response), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(bare, F.lit("{")), bare).otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), bare))


def checked_hints(answers: DataFrame) -> DataFrame:
    """``answers(response, available_rows, ...)`` with hint, status and errors: JSON that parses, keys that are there, rows that exist, a confidence from 0 to 1."""
    text = json_object(F.col("response"))
    rows = answers.withColumns({"hint": F.from_json(text, HINT), "keys": F.json_object_keys(text)})
    absent = [F.when(~F.array_contains("keys", k), F.lit(f"missing {k}")) for k in REQUIRED]
    unknown = [F.when(F.size(F.array_except(F.coalesce(f"hint.{k}", F.array().cast("array<int>")), "available_rows")) > 0, F.lit(f"{k} contains unknown rows")) for k in ROW_LISTS]
    unsure = F.when(~F.coalesce(F.col("hint.confidence").between(0, 1), F.lit(False)), F.lit("confidence must be between 0 and 1"))
    errors = F.when(F.col("keys").isNull(), F.array(F.lit("no JSON object"))).otherwise(F.array_compact(F.array(*absent, *unknown, unsure)))
    status = first_match([(F.col("keys").isNull(), "invalid_json"), (F.size("errors") > 0, "invalid")], "valid")
    return rows.withColumn("errors", errors).withColumn("status", status).drop("keys")


def judged_summary(results: DataFrame, *by: str) -> DataFrame:
    """Over ``results(label, score)``: samples, average score (four places), acceptable or better, partial or better."""
    return results.groupBy(*by).agg(
        F.count("*").alias("sample_count"), F.bround(F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)), 4).alias("average_score"),
        F.count_if(F.col("label").isin(*GOOD_LABELS)).alias("acceptable_or_better"), F.count_if(F.col("label").isin(*FAIR_LABELS)).alias("partial_or_better"),
    )


def closed_book(items: DataFrame, hits: DataFrame, generator: Generator, judge: Generator, model: str = "offline", cache: DataFrame | None = None) -> DataFrame:
    """Masked question and retrieved texts to an answer, answer and held-out value to a label and a score.

    ``items(query_id, query, heldout)``, ``hits(query_id, rank, text)``. The held-out value is in no prompt but the judge's.
    """
    texts = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), "\n").alias("context"))
    asked = items.join(texts, "query_id", "left").withColumn("prompt", F.concat_ws("\n\n", "query", "context"))
    told = ask(asked, generator, model, cache).withColumnRenamed("response", "answer").drop("prompt", "prompt_key", "error", "cached")
    graded = ask(told.withColumn("prompt", F.to_json(F.struct("query", "answer", "heldout"))), judge, f"{model}-judge")
    parsed = F.from_json(json_object(F.col("response")), "label string, score double")
    return graded.select("query_id", "answer", parsed["label"].alias("label"), parsed["score"].alias("score"))
