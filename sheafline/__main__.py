"""Commands: show-config, eval-fields, run-baselines, run-agent, writeback."""

from __future__ import annotations

import argparse
import json
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline import config, schemas
from sheafline.operators import evidence, experiments, metrics, planning, proofs, writeback
from sheafline.sources import ooxml


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _write_csv(df: DataFrame, path: str) -> None:
    """A table with a header; arrays are joined by a semicolon, nulls are empty."""
    flat = [F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def eval_fields(spark: SparkSession, gold: str, pred: str, out: str, k: int = 5, threshold: float = 0.55) -> DataFrame:
    """Metric rows, summary and badcases of predictions against gold fields, written below ``out``; returns the summary."""
    rows = metrics.evaluate(evidence.with_options(schemas.golds(spark, gold)), schemas.predictions(spark, pred), k, threshold)
    _write(rows, f"{out}/rows")
    stored = spark.read.schema(rows.schema).json(f"{out}/rows")
    summary = metrics.summarize(stored)
    _write(summary, f"{out}/summary")
    _write_csv(stored, f"{out}/rows_csv")
    _write(metrics.badcase_counts(stored), f"{out}/badcases")
    return summary


def run_baselines(spark: SparkSession, gold: str, corpus: str, out: str, target: str, k: int = 10) -> DataFrame:
    """The five methods over the same fields; returns a summary of each."""
    fields = evidence.with_options(schemas.golds(spark, gold)).withColumns({"query": F.col("question_text"), "namespace": F.lit(target)})
    rows = experiments.compare(fields, schemas.chunks(spark, corpus), k=k)
    _write(rows, f"{out}/rows")
    summary = metrics.summarize(spark.read.schema(rows.schema).json(f"{out}/rows"), "method")
    _write(summary, f"{out}/summary")
    return summary


def run_agent(spark: SparkSession, gold: str, corpus: str, out: str, target: str, context: str | None = None, settings: config.Settings | None = None) -> DataFrame:
    """Every field's answer with its validation, repair and review, its trace and the review items; returns the answers."""
    settings = settings or config.Settings()
    fields, held = schemas.golds(spark, gold), schemas.chunks(spark, corpus)
    plans = planning.query_plans(fields, target, context, settings.retrieval.global_namespace)
    found = planning.mini_candidates(plans, held).join(held.drop("field_id"), "chunk_id").join(fields.select("field_id", "field_type"), "field_id").withColumn("target", F.lit(target))
    ran = evidence.run_fields(fields, found, settings.agent.confidence_threshold, settings.agent.max_repair_attempts)
    answers = ran.select("field_id", "target_cell", "decision", "answer_value", "answer_status", "confidence", F.col("source_chunk_ids"), "repair_action", "violations", "review_reason")
    _write(answers, f"{out}/predictions")
    stored = spark.read.schema(answers.schema).json(f"{out}/predictions")
    _write(evidence.trace(stored, Path(out).name), f"{out}/trace")
    _write(stored.where("review_reason is not null").select("field_id", F.col("review_reason").alias("reason")), f"{out}/review_items")
    return stored


def fill_workbook(spark: SparkSession, template: str, pred: str, out: str, safe: bool = True, comments: bool = True, trace_id: str | None = None, trace: str | None = None) -> DataFrame:
    """A copy of the template with the answers that may be written and comments that tell their sources; returns the audit of all.

    ``trace``: trace events as JSON Lines; each field's last event by ``seq`` (null where there is none) names its trace,
    before ``trace_id``. The audit, the review items and the evidence map are written as JSON Lines beside ``out``, below
    its name and ``.audit``, ``.review_items`` and ``.evidence_map``.
    """
    data = Path(template).read_bytes()
    book = spark.createDataFrame([("template", bytearray(data))], "file_id string, content binary")
    cells, merges = ooxml.cells(book), ooxml.merges(book)
    first = next(name for _, name, _ in ooxml.sheets(ooxml.zipfile.ZipFile(template)))
    placed = writeback.targets(schemas.predictions(spark, pred), first, merges.select("sheet_name", "first_row", "last_row", "first_col", "last_col"))
    acted = writeback.actions(placed.withColumnRenamed("source_ids", "source_chunk_ids"), cells.where("formula is not null").select("sheet_name", "row", "col"), safe)
    if trace:
        events = spark.read.json(trace)
        seq = F.col("seq").cast("long") if "seq" in events.columns else F.lit(None).cast("long")
        acted = proofs.traced(acted, proofs.trace_index(events.withColumn("seq", seq), ["seq"])).withColumn("trace_id", F.coalesce("trace_id", F.lit(trace_id)))
    acted = writeback.commented(acted, None if trace else trace_id)
    audit = acted.select("field_id", "ordinal", "target_cell", "sheet_name", "cell", "action", "reason", "answer_value", "answer_status", "confidence", "source_chunk_ids", "evidence_attachment_ids", "write_comment", "trace_id", "comment")
    rows = audit.collect()  # the answers of one workbook
    values: dict[tuple[str, str], str] = defaultdict(str)
    values.update({(r.sheet_name, r.cell): r.answer_value or "" for r in rows if r.action == "written"})
    notes: dict[tuple[str, str], str] = {(r.sheet_name, r.cell): r.comment for r in rows if r.write_comment and comments}
    Path(out).write_bytes(ooxml.patch(data, values, notes))
    told = spark.createDataFrame(rows, audit.schema)
    _write(told.drop("ordinal"), f"{out}.audit")
    _write(proofs.review_items(told), f"{out}.review_items")
    _write(proofs.evidence_map(told, ["ordinal"]), f"{out}.evidence_map")
    return told


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sheafline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, needed in (("show-config", ()), ("eval-fields", ("gold", "pred", "out")), ("run-baselines", ("gold", "corpus", "out", "target")), ("run-agent", ("gold", "corpus", "out", "target")), ("writeback", ("template", "pred", "out"))):
        sub = verbs.add_parser(verb)
        sub.add_argument("--config")
        for name in needed:
            sub.add_argument(f"--{name}", required=True)
        if verb == "writeback":
            sub.add_argument("--mode", choices=("safe", "overwrite"), default="safe")
            sub.add_argument("--trace")
    args = parser.parse_args(argv)
    settings = config.load(args.config)
    if args.verb == "show-config":
        print(json.dumps(settings.to_dict(), indent=2, ensure_ascii=False))
        return
    spark = SparkSession.builder.appName("sheafline").getOrCreate()
    if args.verb == "eval-fields":
        eval_fields(spark, args.gold, args.pred, args.out).show(truncate=False)
    elif args.verb == "run-baselines":
        run_baselines(spark, args.gold, args.corpus, args.out, args.target).show(truncate=False)
    elif args.verb == "run-agent":
        run_agent(spark, args.gold, args.corpus, args.out, args.target, settings=settings).show(truncate=False)
    else:
        writeback.summary(fill_workbook(spark, args.template, args.pred, args.out, args.mode == "safe", trace=args.trace)).show(truncate=False)


if __name__ == "__main__":
    main()
