"""Field metrics: exact and semantic match, evidence, abstention, summaries and comparisons of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .evidence import CONSTRAINTS, constraint_violations, numeric
from .order import changed, half_even_rank

#: Statuses with which a prediction abstains, and with which a gold field expects no direct answer.
ABSTAINS = ("not_found", "partial_clue")
NO_ANSWER = ("not_found", "partial_clue", "conflict_unresolved")
#: Seconds and cost that each method is charged for a field.
METHODS = {"naive_fixed_chunk_vector": (12, 0.001), "flat_vector_rag": (20, 0.002), "layered_rag": (32, 0.003), "layered_rag_with_validation": (36, 0.003), "agentic_repair_rag": (55, 0.005)}


def semantic_match(gold: Column, got: Column, kind: Column, aliases: Column) -> Column:
    """Equal as text, as an alias (``aliases`` normalised), or as the type says: truth, number of the same unit, date or list."""
    a, b = T.normalize_text(gold), T.normalize_text(got)
    return _matches(a, b, T.normalize_enum(a, folded=True), T.normalize_enum(b, folded=True), T.parse_number(a, folded=True), T.parse_number(b, folded=True), kind, aliases)


def _matches(a: Column, b: Column, ea: Column, eb: Column, na: Column, nb: Column, kind: Column, aliases: Column) -> Column:
    """``semantic_match`` of normalised texts, options and numbers; they are named several times, so pass columns that hold them."""
    near = F.abs(na["value"] - nb["value"]) <= F.greatest(F.abs(na["value"]) * 1e-6, F.lit(1e-6))
    units = (na["unit"] == nb["unit"]) | (na["unit"] == "") | (nb["unit"] == "")
    named = F.array_contains(F.coalesce(aliases, F.array().cast("array<string>")), eb)
    typed = (
        F.when(kind == "bool", T.normalize_bool(a, folded=True) == T.normalize_bool(b, folded=True))
        .when(kind == "number", near & units)
        .when(kind == "date", T.parse_date(a, folded=True) == T.parse_date(b, folded=True))
        .when(kind == "list", T.normalize_list(a, folded=True) == T.normalize_list(b, folded=True))
        .otherwise(F.lit(False))
    )
    return F.coalesce((a == b) | named | (ea == eb) | typed, F.lit(False))


def evaluate(golds: DataFrame, predictions: DataFrame, k: int = 5, threshold: float = 0.55) -> DataFrame:
    """A row of metrics for every gold field; the last prediction of a field counts, a missing one is ``not_found``.

    ``golds(field_id, expected_value, expected_status, aliases, field_type, required, must_have_evidence, gold_ids,
    regex, options, min, max)``, ``predictions(field_id, ordinal, answer_value, answer_status, confidence, source_ids)``.
    """
    last = predictions.groupBy("field_id").agg(F.max_by(F.struct("answer_value", "answer_status", "confidence", "source_ids"), "ordinal").alias("p")).select("field_id", "p.*")
    # merged, so that fields are dealt to tasks by their number; a scan of a few MB would give their metrics to one task
    rows = golds.join(last.hint("merge"), "field_id", "left").withColumns({
        "answer_status": F.coalesce("answer_status", F.lit("not_found")), "confidence": F.coalesce("confidence", F.lit(0.0)),
        "source_ids": F.coalesce("source_ids", F.array().cast("array<string>")),
    })
    expects, answered = F.col("expected_status") == "answered", F.col("answer_status") == "answered"
    abstained = F.col("answer_status").isin(*ABSTAINS)
    row = {c: F.col(c) for c in CONSTRAINTS}
    # all Arrow functions in one step and none later: Spark merges steps that both have some, and makes again what they share
    rows = rows.withColumns({"__a": T.normalize_text(F.col("expected_value")), "__b": T.normalize_text(F.col("answer_value")), "__expected": T.normalize_enum(F.col("expected_status")), "__status": T.normalize_enum(F.col("answer_status"))})
    a, b = F.col("__a"), F.col("__b")
    rows = rows.withColumns({
        "__ea": T.normalize_enum(a, folded=True), "__eb": T.normalize_enum(b, folded=True),
        "__na": F.when(F.col("field_type") == "number", T.parse_number(a, folded=True)), "__nb": F.when(numeric(row), T.parse_number(b, folded=True)),
    })
    rows = rows.withColumns({
        "exact_match": a == b,
        "semantic_match": _matches(a, b, F.col("__ea"), F.col("__eb"), F.col("__na"), F.col("__nb"), F.col("field_type"), F.col("aliases")),
        "status_match": F.col("__expected") == F.col("__status"),
        "evidence_supported": answered & (F.size("source_ids") > 0),
        "evidence_recall": T.recall_at(F.col("gold_ids"), F.col("source_ids"), k),
        "abstention_correct": F.when(abstained, F.col("expected_status").isin(*NO_ANSWER)),
        "violations": constraint_violations(row | {"folded": b, "number": F.col("__nb.value")}),
    }).drop("__a", "__b", "__expected", "__status", "__ea", "__eb", "__na", "__nb")
    missing = F.col("must_have_evidence") & answered & (F.size("source_ids") == 0)
    wrong = expects & ~F.col("semantic_match")
    rows = rows.withColumn("needs_review", (F.size("violations") > 0) | (F.col("answer_status") == "conflict_unresolved") | (F.col("confidence") < threshold) | missing | wrong)
    rows = rows.withColumn("needs_correction", ~F.col("status_match") | wrong | (~expects & answered))
    cases = F.array(
        F.when(~F.col("exact_match"), "exact_mismatch"), F.when(wrong, "semantic_mismatch"), F.when(~F.col("status_match"), "status_mismatch"),
        F.when(missing, "evidence_missing"), F.when(F.col("evidence_recall") < 1, "evidence_low_recall"), F.when(~F.col("abstention_correct"), "abstention_error"),
        F.when(F.size("violations") > 0, "constraint_violation"), F.when(F.col("needs_review"), "needs_human_review"), F.when(F.col("needs_correction"), "correction_required"),
    )
    return rows.withColumn("badcases", F.array_sort(F.array_compact(cases)))


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    """Rates over metric rows; a rate over no rows is 0."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("field_count"), rate(F.col("exact_match")).alias("exact_match"), rate(F.col("semantic_match")).alias("semantic_match"), rate(F.col("status_match")).alias("status_accuracy"),
        rate(F.col("evidence_supported")).alias("evidence_support"), rate(F.col("evidence_recall")).alias("evidence_recall"), rate(F.col("abstention_correct")).alias("abstention_precision"),
        rate(F.size("violations") > 0).alias("violation_rate"), rate(F.col("needs_review")).alias("review_rate"), rate(F.col("needs_correction")).alias("correction_rate"),
    )


def badcase_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows have each bad case. Equal lists are counted before they are taken apart.

    The outer form keeps Spark from asking first whether the list is empty, for which it would make all metrics of a row twice.
    """
    lists = rows.groupBy(*by, "badcases").agg(F.count("*").alias("n"))
    return lists.select(*by, "n", F.explode_outer("badcases").alias("badcase")).where("badcase is not null").groupBy(*by, "badcase").agg(F.sum("n").alias("n"))


def improvements(base: DataFrame, improved: DataFrame) -> DataFrame:
    """Fields on which the improved method gains, with what it gains."""
    flags = {"semantic": F.col("semantic_match"), "status": F.col("status_match"), "evidence": F.col("evidence_supported"), "valid": F.size("violations") == 0, "no_review": ~F.col("needs_review"), "no_correction": ~F.col("needs_correction")}
    pick = lambda df: df.select("field_id", *[c.alias(n) for n, c in flags.items()])
    return changed(pick(base), pick(improved), "field_id", list(flags))


def p95(df: DataFrame, value: str, *by: str, share: float = 0.95, apart: float = 0.001) -> DataFrame:
    """The value at the 95th hundredth (``share``) of each group's sorted values, the place rounded half to even.

    Nulls don't count; a group without values has no row. Two approximate shares, ``apart`` below and above, cut a group's
    distinct values into three parts, whose exact counts tell which part holds the place; only that part is ranked, which
    is about two thousandths of the group. The cuts decide how long this takes, never the result.
    """
    held = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("all"), *by).alias("__key"), F.col(value).alias("__v"))
    shares = [max(share - apart, 0.0), min(share + apart, 1.0)]
    cuts = held.groupBy("__key").agg(F.percentile_approx("__v", shares, F.lit(10_000)).alias("__cuts"), F.count("*").alias("n"))
    part = (F.col("__v") > F.col("__cuts")[0]).cast("int") + (F.col("__v") > F.col("__cuts")[1]).cast("int")
    counted = held.groupBy("__key", "__v").agg(F.count("*").alias("__count")).join(cuts, "__key").select("__key", "__v", "__count", "n", part.alias("__part"))
    place = F.bround((F.col("n") - 1) * F.lit(share), 0).cast("long")

    parts = counted.groupBy("__key", "__part").agg(F.sum("__count").alias("__size"), F.first("n").alias("n"))
    skip = F.coalesce(F.sum("__size").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holding = parts.withColumn("__skip", skip).where((F.col("__skip") <= place) & (place < F.col("__skip") + F.col("__size"))).select("__key", "__part", "__skip")

    upto = Window.partitionBy("__key").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(holding, ["__key", "__part"]).withColumn("__upto", F.col("__skip") + F.sum("__count").over(upto))
    return ranked.where((F.col("__upto") > place) & (F.col("__upto") - F.col("__count") <= place)).select(*[F.col(f"__key.{c}").alias(c) for c in by], F.col("__v").alias("p95"), "n")


__all__ = ["ABSTAINS", "METHODS", "NO_ANSWER", "badcase_counts", "evaluate", "half_even_rank", "improvements", "p95", "semantic_match", "summarize"]
