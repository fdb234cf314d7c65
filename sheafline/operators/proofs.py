"""What stands behind an answer: the trace of its field, its place in the evidence map, review items, and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .asof import asof, present

#: Columns of a prediction that its evidence record and its review item carry.
RECORD = ("target_cell", "answer_status", "confidence", "source_chunk_ids", "evidence_attachment_ids")
#: References that a summary names, and what stands between them and between their parts.
NAMED, BETWEEN, WITHIN = 3, "；", " / "


def keyed_events(events: DataFrame, at: Sequence[str]) -> DataFrame:
    """``field_id, trace_id`` and ``at`` of the trace events that name both.

    ``events`` may hold any of ``field_id``, ``prediction`` (a struct with ``field_id``), ``trace_id``, ``id`` and
    ``run_id``. The field is the event's own, else its prediction's; the trace is the first of the last three.
    """
    have = set(events.columns)
    fields = [F.col("field_id")] if "field_id" in have else []
    if "prediction" in have and "field_id" in events.schema["prediction"].dataType.fieldNames():
        fields.append(F.col("prediction.field_id"))
    traces = [F.col(c) for c in ("trace_id", "id", "run_id") if c in have]
    none = F.lit(None).cast("string")
    named = events.select(present(*fields, none).alias("field_id"), present(*traces, none).alias("trace_id"), *at)
    return named.where(F.col("field_id").isNotNull() & F.col("trace_id").isNotNull())


def trace_index(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """``field_id, trace_id``: the trace of the last event of each field by ``order``, of equal ones the greatest id.

    An aggregate that combines before it shuffles, so a field with a third of all events is one row a task.
    """
    named = keyed_events(events, order)
    return named.groupBy("field_id").agg(F.max(F.struct(*order, "trace_id")).alias("last")).select("field_id", "last.trace_id")


def traced(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """``predictions`` with ``trace_id`` of their field out of ``index``; null where it has none."""
    return predictions.drop("trace_id").join(index.select("field_id", "trace_id"), "field_id", "left")


def traced_at(predictions: DataFrame, events: DataFrame, at: str, width: int) -> DataFrame:
    """``predictions`` with ``trace_id`` and ``<at>_matched`` of their field as it stood when they were written, by ``at``, a whole number on both sides."""
    return asof(predictions.drop("trace_id"), keyed_events(events, [at]), ["field_id"], at, ["trace_id"], width)


def evidence_map(predictions: DataFrame, order: Sequence[str], earlier: DataFrame | None = None) -> DataFrame:
    """One record a field: target, status, confidence, chunks, attachments and trace of its last prediction by ``order``.

    Fields of ``earlier``, a map of a former write, stay where this one doesn't name them. Every prediction counts, whether
    it was written or not.
    """
    names = [*RECORD, "trace_id"]
    told = predictions.groupBy("field_id").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select("field_id", "r.*")
    if earlier is None:
        return told
    both = told.withColumn("__p", F.lit(1)).unionByName(earlier.select("field_id", *names).withColumn("__p", F.lit(0)))
    return both.groupBy("field_id").agg(F.max_by(F.struct(*names), "__p").alias("r")).select("field_id", "r.*")


def review_items(audit: DataFrame) -> DataFrame:
    """Rows of a write-back's audit that a person must see: all that weren't written, with the reason."""
    rest = [c for c in ("row_index", "answer_value", "trace_id") if c in audit.columns]
    return audit.where(F.col("action") != "written").select("field_id", *[c for c in RECORD if c in audit.columns], *rest, "reason")


def _line(*parts: Column) -> Column:
    return T.display_text(F.concat_ws(WITHIN, *[F.nullif(p, F.lit("")) for p in parts]))


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, source, n_cited, summary`` of each answer.

    ``answers(query_id, references array<struct<file_name, anchor, reason>>, source_chunk_ids)``, ``hits(query_id, rank,
    chunk_id, file_name, anchor, raw_text)``. The first of these that gives something: its first three references that
    aren't null (``references``), the chunks that it cites and its hits hold, in cited order, repeats included (``chunks``), its
    best hit (``best_hit``), nothing (``none``, empty summary). Of hits with the same chunk the last by rank counts.
    """
    wanted = F.filter(F.slice(F.coalesce("references", F.array().cast(answers.schema["references"].dataType)), 1, NAMED), lambda r: r.isNotNull())
    named = answers.select("query_id", wanted.alias("refs"), F.coalesce("source_chunk_ids", F.array().cast(answers.schema["source_chunk_ids"].dataType)).alias("cited"))

    # only answers without references look at their chunks, each cited place is a row
    refs = named.where(F.size("refs") > 0).select("query_id", F.posexplode("refs").alias("pos", "r"))
    refs = refs.select("query_id", "pos", _line(F.col("r.file_name"), F.col("r.anchor"), F.col("r.reason")).alias("line"), F.lit(0).alias("level"))
    held = hits.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct("file_name", "anchor", "raw_text"), "rank").alias("h"))
    places = named.where(F.size("refs") == 0).select("query_id", F.posexplode("cited").alias("pos", "chunk_id"))
    chunks = places.join(held, ["query_id", "chunk_id"]).select("query_id", "pos", _line(F.col("h.file_name"), F.col("h.anchor"), F.col("h.raw_text")).alias("line"), F.lit(1).alias("level")).where("line <> ''")
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("file_name", "anchor", "raw_text"), F.struct("rank", "chunk_id")).alias("h"))
    best = best.select("query_id", F.lit(0).alias("pos"), _line(F.col("h.file_name"), F.col("h.anchor"), F.col("h.raw_text")).alias("line"), F.lit(2).alias("level"))

    lines = refs.unionByName(chunks).unionByName(best)
    grouped = lines.groupBy("query_id", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    first = grouped.groupBy("query_id").agg(F.min_by(F.struct("level", "ls"), "level").alias("f"))
    joined = answers.select("query_id").join(first, "query_id", "left")
    level = F.coalesce("f.level", F.lit(3))
    return joined.select(
        "query_id", F.element_at(F.array(*[F.lit(x) for x in ("references", "chunks", "best_hit", "none")]), level + 1).alias("source"), F.when(level < 2, F.size("f.ls")).otherwise(0).alias("n_cited"),
        F.coalesce(F.array_join(F.transform("f.ls", lambda x: x["line"]), BETWEEN), F.lit("")).alias("summary"),
    )
