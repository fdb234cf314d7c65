"""From worksheet cells to row segments: header rows, merged cells, categories, attachments.

Cells are rows ``(file_id, sheet_index, row, col, value)``; a sheet is a key, never a Python object.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import carry_forward, first_match

SHEET = ("file_id", "sheet_index")
#: Roles of columns as (role, weight, words of its header).
ROLES = (("category", 2, ("分类", "类别", "大类", "category")), ("item", 2, ("项目", "子项", "item")), ("capability", 3, ("能力描述", "要求", "描述", "capability")), ("answer", 3, ("现状", "回答", "应答", "answer")), ("proof", 2, ("证明", "附件", "佐证", "proof")))


def role_of(value: Column, roles: Sequence[tuple[str, int, Sequence[str]]] = ROLES) -> Column:
    """The role of a header cell: the first whose words it has."""
    key = T.compact_key(value)
    return first_match([(key.rlike("|".join(words)), name) for name, _, words in roles], F.lit(None).cast("string"))


def header_rows(cells: DataFrame, roles: Sequence[tuple[str, int, Sequence[str]]] = ROLES, first: int = 15, least: int = 4, latest: bool = False) -> DataFrame:
    """``header_row, score, columns`` of each sheet: the row among its first populated ones whose cells weigh most.

    Of equal weights the earliest row counts, or the latest with ``latest``. ``columns`` maps each role to its
    leftmost column. Sheets whose best row weighs less than ``least`` have none.
    """
    role = role_of(F.col("value"), roles)
    weight = first_match([(F.col("role") == name, w) for name, w, _ in roles], 0)
    named = cells.where(~T.blank(F.col("value"))).withColumn("role", role).withColumn("weight", weight)
    rows = named.groupBy(*SHEET, "row").agg(F.sum("weight").alias("score"))
    near = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("row"))).where(F.col("place") <= first)
    best = near.where(F.col("score") >= least).groupBy(*SHEET).agg(F.max_by(F.struct("row", "score"), F.struct("score", F.col("row") if latest else -F.col("row"))).alias("b"))
    found = best.select(*SHEET, F.col("b.row").alias("header_row"), F.col("b.score").alias("score"))
    at = named.where("role is not null").join(found, list(SHEET)).where("row = header_row").groupBy(*SHEET, "header_row", "score", "role").agg(F.min("col").alias("col"))
    return at.groupBy(*SHEET, "header_row", "score").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "col")))).alias("columns"))


def inherited(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells and, for every place that a merge covers, the value of the merge's first cell.

    ``merges(file_id, sheet_index, first_row, last_row, first_col, last_col)``. A merge is spread over its own rows
    and columns and joined by equality; there is no range join over all cells of a sheet.
    """
    spread = merges.select(*SHEET, "first_row", "first_col", F.explode(F.sequence("first_row", "last_row")).alias("row"), "last_col")
    spread = spread.select(*SHEET, "first_row", "first_col", "row", F.explode(F.sequence("first_col", "last_col")).alias("col"))
    heads = cells.select(*SHEET, F.col("row").alias("first_row"), F.col("col").alias("first_col"), F.col("value").alias("__head"))
    covered = spread.join(heads, [*SHEET, "first_row", "first_col"]).select(*SHEET, "row", "col", "__head")
    joined = cells.join(covered, [*SHEET, "row", "col"], "full_outer")
    return joined.withColumn("value", F.when(T.blank(F.col("value")), F.col("__head")).otherwise(F.col("value"))).drop("__head")


def row_segments(cells: DataFrame, headers: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """A segment for every row below the header that has a capability text: roles' values, texts and attachments.

    ``cells`` have merged values already; categories and items are carried down. ``attachments(file_id,
    sheet_index, row, col, attachment_id)`` are bound to the rows whose proof columns they sit in.
    """
    below = cells.join(headers, list(SHEET)).where(F.col("row") > F.col("header_row"))
    roles = F.explode(F.map_entries("columns"))
    picked = below.select(*SHEET, "row", "col", "value", roles.alias("r")).where("col = r.value")
    wide = picked.groupBy(*SHEET, "row").agg(*[F.max(F.when(F.col("r.key") == name, F.when(~T.blank(F.col("value")), T.collapse(F.col("value"))))).alias(name) for name, _, _ in ROLES])
    filled = wide.withColumns({c: carry_forward(F.col(c), SHEET, ["row"]) for c in ("category", "item")}).where("capability is not null")
    named = filled.withColumn("segment_id", F.concat_ws("_", F.lit("seg"), "file_id", "sheet_index", F.lit("row"), "row"))
    named = named.withColumn("raw_text", F.concat_ws(" | ", "category", "item", "capability", "answer"))
    named = named.withColumn("embedding_text", F.concat_ws("", *[T.sentence_field(c, F.col(c)) for c in ("category", "item", "capability", "answer")]))
    if attachments is None:
        return named.withColumn("proof_attachments", F.array().cast("array<string>"))
    proof = headers.select(*SHEET, F.try_element_at("columns", F.lit("proof")).alias("from_col"))
    bound = attachments.join(proof, list(SHEET)).where(F.col("col") >= F.col("from_col")).transform(bound_attachments, [*SHEET, "row"])
    joined = named.join(bound, [*SHEET, "row"], "left")
    return joined.withColumn("proof_attachments", F.coalesce("proof_attachments", F.array().cast("array<string>")))


def skipped_rows(mapping: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows between ``data_start`` and ``data_end`` of each sheet that no segment came from."""
    every = mapping.select(*SHEET, F.explode(F.sequence("data_start", "data_end")).alias("row"))
    return every.join(segments.select(*SHEET, "row"), [*SHEET, "row"], "left_anti")


def densify(cells: DataFrame, width: Mapping[str, int] | None = None) -> DataFrame:
    """``values`` of each row as an array with a null for every empty place up to the sheet's last column."""
    last = cells.groupBy(*SHEET).agg(F.max("col").alias("width"))
    rows = cells.groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    return rows.join(last, list(SHEET)).select(*SHEET, "row", F.transform(F.sequence(F.lit(1), "width"), lambda c: F.try_element_at(F.col("m"), c)).alias("values"))


def bound_attachments(attachments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``proof_attachments`` of each key: the sorted ids of ``attachments(keys..., attachment_id)``. Counted where they are before they are shuffled."""
    return attachments.groupBy(*keys).agg(F.array_sort(F.collect_list("attachment_id")).alias("proof_attachments"))


def lineage(attachments: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """``attachments`` with the segment of the row they sit in, and the file that is registered under their part of the package.

    ``attachments(file_id, sheet_index, row, attachment_id, media_path)``, ``segments(file_id, sheet_index, row,
    segment_id)``, ``files(file_id, parent_file_id, relative_path)``. Both are left joins by equality: an attachment
    beside all segments has a null ``parent_segment_id``, one that was never unpacked a null ``embedded_file_id``.
    """
    rows = segments.select(*SHEET[:2], "row", F.col("segment_id").alias("parent_segment_id"))
    inner = files.select(F.col("parent_file_id").alias("file_id"), F.col("relative_path").alias("media_path"), F.col("file_id").alias("embedded_file_id"))
    return attachments.join(rows, [*SHEET[:2], "row"], "left").join(inner, ["file_id", "media_path"], "left")


def route(files: DataFrame, rules: Sequence[tuple[str, str]], path: str = "path", numbered: tuple[str, str] | None = None, form: Column | None = None) -> DataFrame:
    """``files`` with route_status, center_id, candidates and confidence, from ordered (center, pattern) rules over the path.

    ``numbered``: (prefix of centres, pattern whose first group is a number), which goes first: one number found is exact
    with 0.99, several, or the pattern's place without a number (its text before the group), are ambiguous with 0.5.
    Then one centre is exact with 0.95, or for rows where ``form`` holds needs a review with 0.62 and names no centre;
    several are ambiguous; a path of the common folder is global, others are unrouted.
    """
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(path).rlike(p), F.lit(c)) for c, p in rules])))
    form = F.coalesce(form, F.lit(False)) if form is not None else F.lit(False)
    found, place = F.array().cast("array<string>"), F.lit(False)
    if numbered:
        found = F.transform(F.array_sort(F.array_distinct(F.regexp_extract_all(path, F.lit(numbered[1]), 1))), lambda n: F.concat(F.lit(numbered[0]), n))
        place = F.col(path).rlike(numbered[1].partition("(")[0])
    own, n = F.size("__numbers"), F.size("__hits")
    status = first_match([
        (own == 1, "exact"), (own > 1, "ambiguous"), ((n == 1) & form, "needs_review"), (n == 1, "exact"), (n > 1, "ambiguous"), (place, "ambiguous"), (F.col(path).rlike("(?i)common|global|通用"), "global"),
    ], "unrouted")
    confidence = first_match([(own == 1, 0.99), (own > 1, 0.5), ((n == 1) & form, 0.62), (n == 1, 0.95), ((n > 1) | place, 0.5)], F.lit(None).cast("double"))
    routed = files.withColumns({"__hits": hits, "__numbers": found}).withColumn("candidates", F.when(own > 0, F.col("__numbers")).otherwise(F.col("__hits")))
    return routed.withColumns({"route_status": status, "center_id": F.when(status == "exact", F.get("candidates", F.lit(0))), "confidence": confidence}).drop("__hits", "__numbers")
