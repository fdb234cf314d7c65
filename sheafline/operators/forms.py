"""Survey forms: sheet kinds, items, return modes and retrieval requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match
from .segments import SHEET, header_rows

#: Roles of a form's columns.
FORM_ROLES = (("question", 3, ("问题", "检查项", "调研项", "question")), ("target", 3, ("填写", "回答", "答复", "answer")), ("status", 2, ("状态", "是否", "status")), ("current", 2, ("现状", "说明", "current")), ("sample", 1, ("示例", "样例", "sample")), ("category", 1, ("分类", "类别", "category")))
#: Words that ask for proof.
PROOF_WORDS = ("证明", "附件", "截图", "照片", "佐证", "proof", "evidence", "screenshot")
#: Values that stand for an empty cell.
PLACEHOLDERS = ("待填写", "请填写", "n/a", "无", "-", "tbd")


def asks_proof(*values: Column) -> Column:
    return F.lower(F.concat_ws(" ", *values)).rlike("|".join(PROOF_WORDS))


def answer_state(value: Column) -> Column:
    return first_match([(T.blank(value), "empty"), (F.lower(T.collapse(value)).isin(*PLACEHOLDERS), "placeholder")], "filled")


def sheet_kind(columns: Column) -> Column:
    """What a sheet is for, by which roles its header has."""
    has = lambda r: F.array_contains(F.map_keys(columns), r)
    return first_match([(columns.isNull() | ~has("question"), "layout"), (has("status") & has("current"), "assessment_matrix"), (has("status"), "filtered_findings")], "fill_form")


def return_mode(kind: Column) -> Column:
    return first_match([(kind == "layout", "evidence_or_layout_reference"), (kind == "assessment_matrix", "status_with_current_info"), (kind == "filtered_findings", "finding_row")], "cell_answer")


def profiles(cells: DataFrame) -> DataFrame:
    """``header_row, columns, sheet_kind, return_mode`` of each sheet; of equal headers the latest counts."""
    found = header_rows(cells, FORM_ROLES, least=3, latest=True)
    rows = cells.select(*SHEET).distinct().join(found, list(SHEET), "left").withColumn("sheet_kind", sheet_kind(F.col("columns")))
    return rows.withColumn("return_mode", return_mode(F.col("sheet_kind")))


def items(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """One item for each row below the header with a question: its texts, target cell, answer state and need of proof."""
    below = cells.join(profile, list(SHEET)).where(F.col("row") > F.col("header_row"))
    picked = below.select(*SHEET, "row", "col", "value", "columns", "return_mode", F.explode(F.map_entries("columns")).alias("r")).where("col = r.value")
    pick = lambda name: F.max(F.when(F.col("r.key") == name, F.col("value"))).alias(name)
    wide = picked.groupBy(*SHEET, "row").agg(*[pick(n) for n, _, _ in FORM_ROLES], F.first("columns").alias("columns"), F.first("return_mode").alias("return_mode")).where(~T.blank(F.col("question")))
    at = F.coalesce(F.try_element_at("columns", F.lit("target")), F.try_element_at("columns", F.lit("status")))
    return wide.select(
        *SHEET, "row", T.stable_hash(F.col("file_id"), F.col("sheet_index"), F.col("row")).alias("form_item_id"), T.collapse(F.col("category")).alias("category"), T.collapse(F.col("question")).alias("question"),
        F.when(at.isNotNull(), T.cell_ref(F.col("row"), at)).alias("target_cell"), F.col("target").alias("existing_value"), answer_state(F.col("target")).alias("answer_state"), asks_proof(F.col("question"), F.col("sample")).alias("needs_evidence"), "return_mode",
    )


def requests(form_items: DataFrame, namespace: str, top_k: int = 40, top_n: int = 10) -> DataFrame:
    """A retrieval request for every item; the existing value never enters the query."""
    task = first_match([(F.col("answer_state") == "empty", "fill_empty"), (F.col("answer_state") == "placeholder", "fill_placeholder"), (F.col("return_mode") == "status_with_current_info", "fill_or_verify")], "verify_or_rewrite_existing")
    query = F.concat_ws(" ", F.lit(namespace), F.when(F.col("category") != "", F.col("category")), F.col("question"))
    kind = first_match([(F.col("return_mode") == "status_with_current_info", "status"), (F.col("question").rlike("是否|有无"), "bool"), (F.col("question").rlike("数量|多少|容量|功率"), "number"), (F.col("question").rlike("日期|时间"), "date")], "text")
    retrieval = F.struct(query.alias("query_text"), F.lit(top_k).alias("vector_top_k"), F.lit(top_n).alias("rerank_top_n"), F.array(F.lit(namespace), F.lit("global")).alias("namespaces"))
    return form_items.select(T.stable_hash(F.col("form_item_id"), F.lit(namespace)).alias("request_id"), "form_item_id", F.lit(namespace).alias("target_namespace"), F.col("return_mode").alias("mode"), task.alias("task_action"), kind.alias("answer_type"), retrieval.alias("retrieval"))
