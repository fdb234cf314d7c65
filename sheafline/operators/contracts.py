"""Contracts of answers as rows, checks of answers against them, and templates of retrieval inputs by kind of sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match
from .services import json_object

LAYOUT = "evidence_or_layout_reference"
#: The modes of an answer with the fields that each must have, and the further ones that it may have.
REQUIRED = {
    "cell_answer": ("answer_value", "confidence", "source_chunks"),
    "status_with_current_info": ("status", "current_info", "confidence", "source_chunks"),
    "finding_row": ("category", "question", "status", "current_info", "source_chunks"),
    "risk_row": ("risk_description", "risk_level", "impact", "mitigation", "source_chunks"),
}
OPTIONAL = {
    "cell_answer": ("answer_unit", "answer_basis"),
    "status_with_current_info": ("status_reason",),
    "finding_row": (),
    "risk_row": ("room_or_building", "risk_category", "deadline", "progress"),
}
#: Fields that every mode may have.
COMMON = ("form_item_id", "file_name", "sheet_name", "target_cell", "mode", "query", "confidence", "source_chunks", "evidence_attachments", "missing_fields", "notes")
#: What a status may be.
VALUES = {("status_with_current_info", "status"): ("满足", "部分满足", "不满足", "不涉及", "未找到"), ("finding_row", "status"): ("不满足", "部分满足")}
#: The mode of each kind of sheet, and the fields that its requests hold beside the common ones.
KIND_MODES = {"assessment_matrix": "status_with_current_info", "filtered_findings": "finding_row", "risk_register": "risk_row", "layout": LAYOUT}
KIND_FIELDS = {"assessment_matrix": ("status", "current"), "filtered_findings": ("status", "current"), "risk_register": ("target", "current")}
BASE_FIELDS = ("target_namespace", "category", "question")
#: Numbers of a retrieval and layers that it may name.
TOP_K, TOP_N, LAYERS, DEFAULT_LAYERS = 40, 10, ("fact", "evidence", "meta", "template"), ("fact", "evidence")


def contract_rows(spark: SparkSession) -> DataFrame:
    """``mode, position, field, required, allowed``: the contracts as a table, for joins, reports and SQL."""
    rows = [(m, i, f, f in REQUIRED[m], list(VALUES.get((m, f), ()))) for m in REQUIRED for i, f in enumerate(dict.fromkeys((*REQUIRED[m], *OPTIONAL[m], *COMMON)))]
    return spark.createDataFrame(rows, "mode string, position int, field string, required boolean, allowed array<string>")


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def checked(answers: DataFrame) -> DataFrame:
    """``answers(mode, answer)`` with ``problems`` and ``unknown_fields``; ``answer`` is a JSON object, also in fences or among words.

    Problems, in this order: no JSON object (then nothing else), unknown mode (nothing else), required fields that are
    absent, null, blank or empty lists, a confidence that is there and isn't a number from 0 to 1, a status that is none of the
    mode's values. One expression over each row; the contract is in the plan as constants.
    """
    held = answers.withColumn("__a", F.from_json(json_object(F.col("answer")), "map<string,string>"))
    have = F.filter(F.coalesce(F.map_keys("__a"), _texts()), lambda f: ~F.trim(F.coalesce(F.try_element_at("__a", f), F.lit(""))).isin("", "[]", "{}", "null"))
    held = held.withColumn("__have", have)
    wanted = first_match([(F.col("mode") == m, _texts(*fs)) for m, fs in REQUIRED.items()], F.lit(None).cast("array<string>"))
    known = first_match([(F.col("mode") == m, _texts(*dict.fromkeys((*fs, *OPTIONAL[m], *COMMON)))) for m, fs in REQUIRED.items()], _texts())
    missing = F.transform(F.array_except(wanted, "__have"), lambda f: F.concat(F.lit("missing "), f))
    given = lambda f: F.array_contains("__have", f)
    sure = F.coalesce(F.try_element_at("__a", F.lit("confidence")).try_cast("double").between(0, 1), F.lit(False))
    wrong = [F.when(given("confidence") & ~sure, "confidence must be between 0 and 1")]
    wrong += [F.when((F.col("mode") == m) & given(f) & ~F.trim(F.try_element_at("__a", F.lit(f))).isin(*vs), f"{f} is none of its values") for (m, f), vs in VALUES.items()]
    problems = first_match([(F.col("__a").isNull(), _texts("no JSON object")), (wanted.isNull(), _texts("unknown mode"))], F.concat(missing, F.array_compact(F.array(*wrong))))
    unknown = F.when(wanted.isNotNull() & F.col("__a").isNotNull(), F.array_sort(F.array_except(F.map_keys("__a"), known))).otherwise(_texts())
    return held.withColumns({"problems": problems, "unknown_fields": unknown}).drop("__a", "__have")


def template_mode(kind: Column, hinted: Column) -> Column:
    """The mode of a sheet: layouts are references, no other sheet is; a hinted mode counts if there is such a mode."""
    base = first_match([(kind == k, m) for k, m in KIND_MODES.items()], "cell_answer")
    return first_match([(kind == "layout", LAYOUT), (hinted == LAYOUT, "cell_answer"), (hinted.isin(*REQUIRED), hinted)], base)


def templates(sheets: DataFrame) -> DataFrame:
    """``sheets(sheet_kind, hinted_mode, has_sample, needs_evidence)`` with mode, include_fields, auxiliary_fields and retrieval."""
    extra = first_match([(F.col("sheet_kind") == k, _texts(*fs)) for k, fs in KIND_FIELDS.items()], _texts())
    helping = F.concat(_texts("instruction"), F.when(F.coalesce("has_sample", F.lit(False)), _texts("sample")).otherwise(_texts()))
    retrieval = F.struct(_texts(*DEFAULT_LAYERS).alias("layers"), F.lit(TOP_K).alias("vector_top_k"), F.lit(TOP_N).alias("rerank_top_n"))
    return sheets.withColumns({
        "template_source": F.lit("deterministic"), "mode": template_mode(F.col("sheet_kind"), F.col("hinted_mode")), "include_fields": F.concat(_texts(*BASE_FIELDS), extra),
        "auxiliary_fields": helping, "needs_evidence": F.coalesce("needs_evidence", F.lit(False)), "retrieval": retrieval,
    })


def revised(made: DataFrame) -> DataFrame:
    """Templates under what a model answered in ``response``: its fields where they aren't empty, unknown modes and layers left out.

    A template of a layout stays one. A response that holds no JSON object changes nothing.
    """
    told = F.from_json(json_object(F.col("response")), "rag_return_mode string, include_fields array<string>, auxiliary_fields array<string>, retrieval_policy struct<layers: array<string>, vector_top_k: int, rerank_top_n: int>")
    rows = made.withColumn("__m", told)
    some = lambda c: F.when(F.size(c) > 0, c)
    mode = F.col("__m.rag_return_mode")
    named = F.filter(F.col("__m.retrieval_policy.layers"), lambda x: x.isin(*LAYERS))
    number = lambda c: F.coalesce(F.nullif(F.col(f"__m.retrieval_policy.{c}"), F.lit(0)), F.col(f"retrieval.{c}")).alias(c)
    parsed = F.json_object_keys(json_object(F.col("response"))).isNotNull()
    return rows.withColumns({
        "template_source": F.when(parsed, "model").otherwise(F.col("template_source")),
        "mode": F.when((F.col("mode") != LAYOUT) & mode.isin(*REQUIRED, LAYOUT), mode).otherwise(F.col("mode")),
        "include_fields": F.coalesce(some(F.col("__m.include_fields")), "include_fields"), "auxiliary_fields": F.coalesce(some(F.col("__m.auxiliary_fields")), "auxiliary_fields"),
        "retrieval": F.struct(F.coalesce(named, "retrieval.layers").alias("layers"), number("vector_top_k"), number("rerank_top_n")),
    }).drop("__m")


def inputs(items: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """``items(<key>, fields map<string,string>)`` with the query and the helping text that their sheet's template makes of their fields.

    The template is expanded by one expression: its fields in order, those that the item has, each collapsed. Items of a
    sheet without a template are left out.
    """
    joined = items.join(made.select(key, "mode", "include_fields", "auxiliary_fields", "retrieval"), key)
    spread = lambda names: F.array_join(F.filter(F.transform(names, lambda f: T.collapse(F.try_element_at("fields", f))), lambda v: v != ""), " ")
    return joined.withColumns({"query_text": spread(F.col("include_fields")), "help_text": spread(F.col("auxiliary_fields"))})


def prompts(made: DataFrame, items: DataFrame, key: str, order: str, sample: int = 8) -> DataFrame:
    """``<key>, prompt``: each template with at most ``sample`` items of its sheet, asking for a better one as JSON.

    The sample is the first items by ``order``; Spark limits each task's rows of a sheet to the sample before they are
    shuffled. The prompt shows questions, not answers.
    """
    rows = made.join(_firsts(items, key, order, sample), key, "left")
    shown = F.to_json(F.struct("sheet_kind", "mode", "include_fields", "auxiliary_fields", "retrieval", F.coalesce("sample", _texts()).alias("sample_items")))
    rules = "Return one JSON object with rag_return_mode, include_fields, auxiliary_fields and retrieval_policy. Name fields only; write no answers. Samples and existing values are hints on format, never evidence. Allowed modes: " + ", ".join((*REQUIRED, LAYOUT)) + "."
    return rows.select(key, F.concat(F.lit(rules), F.lit("\n"), shown).alias("prompt"))


def _firsts(items: DataFrame, key: str, order: str, sample: int) -> DataFrame:
    question = T.collapse(F.try_element_at("fields", F.lit("question")))
    ranked = items.select(key, F.col(order).alias("__o"), question.alias("__q")).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__o", "__q"))).where(F.col("__n") <= sample)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__q"))), lambda x: x["__q"]).alias("sample"))
