"""Write-back of predictions to workbook cells: targets, conflicts, actions, audit and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match

#: The last row and column of a sheet.
LAST_ROW, LAST_COL = 1_048_576, 16_384


def targets(predictions: DataFrame, default_sheet: str, merges: DataFrame | None = None) -> DataFrame:
    """``predictions`` with sheet_name, row, col and cell of ``target_cell``; null where the address is none.

    The sheet is what stands before the last ``!``, quotes taken off; merged cells lead to the first of the merge.
    ``merges(sheet_name, first_row, last_row, first_col, last_col)``.
    """
    at = F.col("target_cell")
    sheet = F.regexp_replace(F.regexp_extract(at, r"^(.*)!([^!]*)$", 1), "^'|'$", "")
    sheet = F.when(F.contains(at, F.lit("!")), F.replace(sheet, F.lit("''"), F.lit("'"))).otherwise(F.lit(default_sheet))
    ref = T.split_ref(F.trim(F.regexp_replace(at, r"^.*!", "")))
    inside = ref["row"].between(1, LAST_ROW) & ref["col"].between(1, LAST_COL)
    out = predictions.withColumns({"sheet_name": sheet, "row": F.when(inside, ref["row"]), "col": F.when(inside, ref["col"])})
    if merges is not None:
        spread = merges.select(F.col("sheet_name"), F.col("first_row"), F.col("first_col"), F.explode(F.sequence("first_row", "last_row")).alias("row"), "last_col")
        spread = spread.select("sheet_name", "first_row", "first_col", "row", F.explode(F.sequence("first_col", "last_col")).alias("col"))
        out = out.join(spread, ["sheet_name", "row", "col"], "left").withColumns({"row": F.coalesce("first_row", "row"), "col": F.coalesce("first_col", "col")}).drop("first_row", "first_col")
    return out.withColumn("cell", F.when(F.col("row").isNotNull(), T.cell_ref(F.col("row"), F.col("col"))))


def failed_validation(rows: Column) -> Column:
    return F.coalesce(rows["validation_pass"] == F.lit(False), F.lit(False)) | F.coalesce(rows["evidence_missing"], F.lit(False)) | (F.size(F.coalesce(rows["violations"], F.array().cast("array<string>"))) > 0)


def actions(placed: DataFrame, formulas: DataFrame | None = None, safe: bool = True) -> DataFrame:
    """``placed`` with action, reason and write_comment. All predictions of a cell that several aim at are conflicts.

    ``formulas(sheet_name, row, col)`` are cells that hold one; they are left alone in safe mode.
    """
    n = F.count("*").over(Window.partitionBy("sheet_name", "row", "col"))
    rows = placed.withColumn("n_at_cell", F.when(F.col("row").isNotNull(), n).otherwise(1))
    if formulas is not None:
        rows = rows.join(formulas.select("sheet_name", "row", "col").distinct().withColumn("is_formula", F.lit(True)), ["sheet_name", "row", "col"], "left")
    else:
        rows = rows.withColumn("is_formula", F.lit(False))
    failed = failed_validation(F.struct("validation_pass", "evidence_missing", "violations"))
    reason = first_match([
        (F.col("row").isNull(), "invalid_cell"), (F.col("n_at_cell") > 1, "duplicate_target_cell"), (F.col("answer_status") != "answered", "skipped_status"),
        (failed, "validation_failed"), (F.coalesce("is_formula", F.lit(False)) & F.lit(safe), "skipped_formula"),
    ], "written")
    action = first_match([(reason == "invalid_cell", "invalid"), (reason == "duplicate_target_cell", "conflict"), (reason == "written", "written")], "skipped")
    return rows.withColumns({"reason": reason, "action": action, "write_comment": reason.isin("written", "skipped_status", "validation_failed")}).drop("is_formula")


def commented(audit: DataFrame, trace_id: str | None = None) -> DataFrame:
    """``audit`` with trace_id and the comment of each row that gets one, null for the others."""
    have = set(audit.columns)
    ids = lambda c: F.col(c) if c in have else F.array().cast("array<string>")
    traced = audit.withColumn("trace_id", F.coalesce(F.lit(trace_id), F.col("trace_id") if "trace_id" in have else F.lit(None).cast("string")))
    confidence = F.col("confidence").cast("double") if "confidence" in have else F.lit(None).cast("double")
    text = T.prediction_comment(confidence, ids("source_chunk_ids"), ids("evidence_attachment_ids"), F.col("answer_status"), F.col("trace_id"))
    return traced.withColumn("comment", F.when(F.col("write_comment"), text))


def summary(audit: DataFrame) -> DataFrame:
    """Counts of the audit by action."""
    n = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    return audit.agg(F.count("*").alias("n_fields"), n("written"), n("skipped"), n("conflict"), n("invalid"), F.count_if(F.col("action") != "written").alias("n_review"))
