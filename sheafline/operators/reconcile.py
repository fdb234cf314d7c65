"""Reconciliations: what either side lacks and where counts differ, in one aggregate; audits of sheets and documents by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match
from .segments import SHEET

#: How a numbered heading starts, and how long one may be.
NUMBERED = r"^([一二三四五六七八九十]+、|[0-9]+、)"
SHORT = 40


def reconciled(expected: DataFrame, actual: DataFrame, keys: Sequence[str], n_expected: Column | None = None, n_actual: Column | None = None) -> DataFrame:
    """``keys, n_expected, n_actual, status`` for every key of either side: equal, differs, missing or unexpected.

    Each row counts one, or what ``n_expected`` and ``n_actual`` say (null: none). Null keys are keys like any other. Both
    sides are counted before the one shuffle, so a hot key is one row a task; there is no join and no second pass
    for the rows that only one side has. A key that a side names with a count of 0 is there, not missing.
    """
    no = F.lit(0).cast("long")
    one = lambda c: F.coalesce((F.lit(1) if c is None else c).cast("long"), no)
    a = expected.select(*keys, one(n_expected).alias("e"), no.alias("a"), F.lit(True).alias("in_e"), F.lit(False).alias("in_a"))
    b = actual.select(*keys, no.alias("e"), one(n_actual).alias("a"), F.lit(False).alias("in_e"), F.lit(True).alias("in_a"))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("e").alias("n_expected"), F.sum("a").alias("n_actual"), F.max("in_e").alias("in_e"), F.max("in_a").alias("in_a"))
    status = first_match([(~F.col("in_e"), "unexpected"), (~F.col("in_a"), "missing"), (F.col("n_expected") != F.col("n_actual"), "differs")], "equal")
    return both.select(*keys, "n_expected", "n_actual", status.alias("status"))


def totals(compared: DataFrame, *by: str) -> DataFrame:
    """Counts of a reconciliation's keys by status, and both sides' sums."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return compared.groupBy(*by).agg(F.count("*").alias("n_keys"), n("equal"), n("differs"), n("missing"), n("unexpected"), F.sum("n_expected").alias("expected"), F.sum("n_actual").alias("actual"))


def compared_attachments(segments: DataFrame, attachments: DataFrame) -> DataFrame:
    """Rows of segments whose ``proof_attachment_count`` isn't the number of ``attachments(file_id, sheet_index, row)`` of their row.

    Attachments in rows of no segment are another matter: ``reconciled`` names them ``unexpected``; here they are left out.
    """
    found = reconciled(segments, attachments, [*SHEET[:2], "row"], F.col("proof_attachment_count"))
    # a segment that expects none and has none is "missing" to the reconciliation and right here
    return found.where((F.col("status") != "unexpected") & (F.col("n_expected") != F.col("n_actual")))


def audited_segments(mapping: DataFrame, segments: DataFrame, attachments: DataFrame) -> DataFrame:
    """``file_id, n_segments, n_skipped, n_bare, n_attachments_differ, verdict`` of every file of ``mapping``.

    ``mapping(file_id, sheet_index, data_start, data_end)``, ``segments(file_id, sheet_index, row, capability, answer,
    proof_attachment_count)``. Skipped rows have no segment; bare segments neither a capability nor an answer. Files
    pass unless they have bare segments or attachments that differ. Skipped rows are counted out of the lengths of the ranges
    and the distinct rows inside them, so that no range is spread.
    """
    place = [*SHEET[:2]]
    spans = mapping.groupBy(*place).agg(F.min("data_start").alias("data_start"), F.max("data_end").alias("data_end"))
    inside = segments.join(spans, place, "left")
    bare = T.blank(F.col("capability")) & T.blank(F.col("answer"))
    per_row = inside.groupBy(*place, "row").agg(F.count("*").alias("n"), F.count_if(bare).alias("bare"), F.max(F.coalesce(F.col("row").between(F.col("data_start"), F.col("data_end")), F.lit(False))).alias("inside"))
    rows = per_row.groupBy("file_id").agg(F.sum("n").alias("n_segments"), F.sum("bare").alias("n_bare"), F.count_if("inside").alias("n_rows"))
    lengths = spans.groupBy("file_id").agg(F.sum(F.greatest(F.col("data_end") - F.col("data_start") + 1, F.lit(0)).cast("long")).alias("length"))
    differ = compared_attachments(segments, attachments).groupBy("file_id").agg(F.count("*").alias("differ"))
    joined = lengths.join(rows, "file_id", "left").join(differ, "file_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    verdict = F.when((n("n_bare") == 0) & (n("differ") == 0), "pass").otherwise("review")
    return joined.select("file_id", n("n_segments").alias("n_segments"), (F.col("length") - n("n_rows")).alias("n_skipped"), n("n_bare").alias("n_bare"), n("differ").alias("n_attachments_differ"), verdict.alias("verdict"))


def headings(blocks: DataFrame) -> DataFrame:
    """Paragraphs that start like numbered headings, with ``length`` and ``is_short``; long ones are likely to be text."""
    text = F.trim(F.col("text"))
    return blocks.where((F.col("block_type") == "paragraph") & text.rlike(NUMBERED)).withColumns({"length": F.length(text), "is_short": F.length(text) <= SHORT})


def invalid_media(media_path: Column) -> Column:
    """Whether a part of a package is no file: a folder, or a name without an ending; null counts as such."""
    name = F.element_at(F.split(F.coalesce(media_path, F.lit("")), "/"), -1)
    return ~name.rlike(r"^.+\.[^.]+$")


def audited_documents(files: DataFrame, blocks: DataFrame, attachments: DataFrame) -> DataFrame:
    """``file_id, n_paragraphs, n_table_cells, n_short, n_long, n_media, n_invalid_media, verdict`` of every document of ``files``.

    ``blocks(file_id, block_type, text)``, ``attachments(file_id, media_path)``. Headings as in ``headings``. Both sides are
    counted a file before they meet; a document with neither blocks nor media passes with zeros.
    """
    text = F.trim(F.col("text"))
    titled = (F.col("block_type") == "paragraph") & F.coalesce(text.rlike(NUMBERED), F.lit(False))
    said = blocks.groupBy("file_id").agg(
        F.count_if(F.col("block_type") == "paragraph").alias("n_paragraphs"), F.count_if(F.col("block_type") == "table_cell").alias("n_table_cells"),
        F.count_if(titled & (F.length(text) <= SHORT)).alias("n_short"), F.count_if(titled & (F.length(text) > SHORT)).alias("n_long"),
    )
    held = attachments.groupBy("file_id").agg(F.count("*").alias("n_media"), F.count_if(invalid_media(F.col("media_path"))).alias("n_invalid_media"))
    rows = files.select("file_id").distinct().join(said, "file_id", "left").join(held, "file_id", "left").fillna(0)
    return rows.withColumn("verdict", F.when(F.col("n_invalid_media") == 0, "pass").otherwise("review_media"))
