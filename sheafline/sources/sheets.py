"""Summaries of workbooks: each sheet's declared and real extent, what is hidden, merged, computed and attached.

Hidden rows and columns are ranges that cells are joined with; a column range over a whole sheet is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators.intervals import covered_length, with_cover
from sheafline.sources import ooxml

SHEET = ["file_id", "sheet_index"]


def with_hidden(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """``cells`` with is_hidden_row and is_hidden_col, by the hidden ranges of ``ooxml.layout``."""
    hidden = layout.where("kind = 'hidden_rows'"), layout.where("kind = 'hidden_cols'")
    return with_cover(with_cover(cells, hidden[0], SHEET, "row", "is_hidden_row"), hidden[1], SHEET, "col", "is_hidden_col")


def sheet_summaries(cells: DataFrame, merges: DataFrame, attachments: DataFrame, layout: DataFrame) -> DataFrame:
    """One row for each sheet that a workbook lists.

    file_id, sheet_index, sheet_name, worksheet_path, parse_status (``ok`` or ``missing_part``), declared_dimension,
    actual_min_cell, actual_max_cell, actual_dimension (of cells with a value or formula; null where there are none), and
    counts: cells, formulas, image formulas, merges, attachments, hidden rows and columns (as declared), cells that are
    hidden by either.
    """
    listed = layout.where(F.col("kind").isin("sheet", "missing")).select(*SHEET, "sheet_name", F.col("ref").alias("worksheet_path"), F.when(F.col("kind") == "sheet", "ok").otherwise("missing_part").alias("parse_status"))
    declared = layout.where("kind = 'dimension'").groupBy(*SHEET).agg(F.min("ref").alias("declared_dimension"))
    flagged = with_hidden(cells, layout)
    counted = flagged.groupBy(*SHEET).agg(
        F.count("*").alias("non_empty_cell_count"), F.count_if(F.col("formula").isNotNull()).alias("formula_count"), F.count_if(F.col("formula_kind") == "image").alias("image_formula_count"), F.count_if(F.col("is_hidden_row") | F.col("is_hidden_col")).alias("hidden_cell_count"),
        F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"),
    )
    parts = [
        declared, counted, merges.groupBy(*SHEET).agg(F.count("*").alias("merge_count")), attachments.groupBy(*SHEET).agg(F.count("*").alias("attachment_count")),
        covered_length(layout.where("kind = 'hidden_rows'"), SHEET, "hidden_row_count"), covered_length(layout.where("kind = 'hidden_cols'"), SHEET, "hidden_col_count"),
    ]
    out = listed
    for part in parts:
        out = out.join(part, SHEET, "left")
    least, most = T.cell_ref(F.col("r1"), F.col("c1")), T.cell_ref(F.col("r2"), F.col("c2"))
    numbers = ("non_empty_cell_count", "formula_count", "image_formula_count", "merge_count", "attachment_count", "hidden_row_count", "hidden_col_count", "hidden_cell_count")
    return out.select(
        *SHEET, "sheet_name", "worksheet_path", "parse_status", "declared_dimension", least.alias("actual_min_cell"), most.alias("actual_max_cell"), F.concat(least, F.lit(":"), most).alias("actual_dimension"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
    )


def summarised(files: DataFrame) -> DataFrame:
    """``sheet_summaries`` of the workbooks ``files(file_id, content)``."""
    return sheet_summaries(ooxml.cells(files), ooxml.merges(files), ooxml.attachments(files), ooxml.layout(files))


def workbook_summaries(sheets: DataFrame) -> DataFrame:
    """One row a workbook: sheets that are there, totals, and the sheets whose part is missing."""
    there = F.col("parse_status") == "ok"
    return sheets.groupBy("file_id").agg(
        F.count_if(there).alias("sheet_count"), F.sum("non_empty_cell_count").alias("total_cell_count"), F.sum("formula_count").alias("total_formula_count"), F.sum("image_formula_count").alias("total_image_formula_count"), F.sum("attachment_count").alias("total_attachment_count"),
        F.array_sort(F.collect_list(F.when(~there, F.concat(F.lit("worksheet missing: "), F.col("sheet_name"))))).alias("diagnostics"),
    )
