"""From retrieved chunks to answers: evidence decisions, predictions, validation, one repair, review.

Every step is a projection or an aggregate by field, so a run over all fields is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match

#: Fixed value: what stands where no answer was found.
NOT_FOUND = "未找到"
#: Confidence of each decision, and the status it gives.
DECISIONS = {"use_direct_evidence": ("answered", 0.9), "clue_only": ("partial_clue", 0.4), "conflict_unresolved": ("conflict_unresolved", 0.2), "no_evidence": ("not_found", 0.0)}
#: Answers that decide nothing.
UNCERTAIN = ("可能", "待复核", "不确定", "未知", "待确认", "需确认")
#: Source types in order of preference.
MAIN, EMBEDDED, INTRO = "main_excel_capability", "embedded_word_table", "intro_doc_paragraph"
MAX_ANSWER = 120
#: The priorities that sources of the target's own namespace can have.
OWN = (1, 2, 3, 4)


def source_priority(namespace: Column, target: Column, source_type: Column) -> Column:
    """1 to 6: the target's main rows, embedded tables, others, intro documents; others' intro documents; the rest."""
    own, intro = namespace == target, source_type == INTRO
    return first_match([(own & (source_type == MAIN), 1), (own & (source_type == EMBEDDED), 2), (own & intro, 4), (own, 3), (intro, 5)], 6)


def usable(status: Column, answer: Column) -> Column:
    return (F.coalesce(status, F.lit("answered")) == "answered") & ~T.collapse(answer).isin("", NOT_FOUND)


def answer_key(truth: Column, option: Column) -> Column:
    """What answers are compared by: 是 or 否 where they say so, else the option. truth: what the answer says, option: the normalised answer."""
    return F.when(truth, "是").when(~truth, "否").otherwise(option)


def select_evidence(candidates: DataFrame) -> DataFrame:
    """A decision for each field of ``candidates(field_id, field_type, target, chunk_id, namespace, source_type, answer_value, answer_status, score)``.

    Returns field_id, decision, chunk (the one that answers), chunk_ids of the conflict or for reference. Order of
    decisions: nothing of the target's namespace is a clue only; target chunks of one priority that disagree are a
    conflict; else the first usable and certain chunk by priority and score answers. A bool field whose main
    chunks are all uncertain takes an embedded chunk that says true or false. Fields without candidates are not
    here; join from the fields and take ``no_evidence`` for them.
    One aggregate by field, so candidates are read and shuffled once; ids of chunks are collected only where they are asked for.
    """
    return _decided(candidates)


def _decided(candidates: DataFrame, *more: str) -> DataFrame:
    """``select_evidence``; ``more`` may name ``folded``, the normalised answer, for the chunk to carry."""
    own = F.col("namespace") == F.col("target")
    rows = candidates.withColumns({"own": own, "priority": source_priority(F.col("namespace"), F.col("target"), F.col("source_type")), "folded": T.normalize_text(F.col("answer_value"))})
    rows = rows.withColumn("option", T.normalize_enum(F.col("folded"), folded=True))
    rows = rows.withColumns({"good": F.col("own") & usable(F.col("answer_status"), F.col("answer_value")), "truth": T.normalize_bool(F.col("option"), folded=True)})
    rows = rows.withColumns({"key": answer_key(F.col("truth"), F.col("option")), "says": F.col("truth").isNotNull(), "sure": F.col("good") & ~F.col("option").isin(*UNCERTAIN)})
    # the chunk that answers is the least of these; what comes after chunk_id only rides along
    chunk = F.struct("priority", (-F.col("score")).alias("down"), "chunk_id", "answer_value", "source_type", "namespace", "score", *more)
    main, embedded = F.col("good") & (F.col("priority") == 1), F.col("good") & (F.col("priority") == 2) & F.col("says")
    ident = F.col("chunk_id").cast("string").alias("id")
    extremes = [f(F.when(F.col("good") & (F.col("priority") == p), F.col("key"))).alias(f"{name}{p}") for p in OWN for f, name in ((F.min, "low"), (F.max, "high"))]
    best = rows.groupBy("field_id").agg(
        F.first("field_type").alias("field_type"),
        F.count_if("own").alias("n_own"),
        F.min(F.when(F.col("sure"), chunk)).alias("direct"),
        F.min(F.when(embedded, chunk)).alias("explicit"),
        F.count_if(main).alias("n_main"), F.count_if(main & ~F.col("sure")).alias("n_unsure"), *extremes,
        F.collect_set(F.when(F.col("own"), F.struct("priority", ident))).alias("own_ids"), F.array_sort(F.collect_set(F.when(~F.col("own"), ident))).alias("other_ids"),
    )
    # answers disagree where the least and the greatest differ
    best = best.withColumn("conflict", first_match([(F.col(f"low{p}") != F.col(f"high{p}"), p) for p in OWN], F.lit(None).cast("int")))
    conflict_ids = F.array_sort(F.transform(F.filter("own_ids", lambda x: x["priority"] == F.col("conflict")), lambda x: x["id"]))
    swap = (F.col("field_type") == "bool") & (F.col("n_main") > 0) & (F.col("n_main") == F.col("n_unsure")) & F.col("explicit").isNotNull()
    best = best.withColumn("picked", F.when(swap, F.col("explicit")).otherwise(F.col("direct")))
    best = best.withColumn("decision", first_match([(F.col("n_own") == 0, "clue_only"), (F.col("conflict").isNotNull(), "conflict_unresolved"), (F.col("picked").isNull(), "no_evidence")], "use_direct_evidence"))
    ids = first_match([(F.col("decision") == "clue_only", F.col("other_ids")), (F.col("decision") == "conflict_unresolved", conflict_ids)], F.array().cast("array<string>"))
    told = F.struct(*[F.col(f"picked.{c}") for c in ("chunk_id", "answer_value", "source_type", "namespace", "priority", "score", *more)])
    return best.select("field_id", "decision", F.when(F.col("decision") == "use_direct_evidence", told).alias("chunk"), ids.alias("chunk_ids"))


def predictions(fields: DataFrame, decided: DataFrame) -> DataFrame:
    """``fields(field_id, ...)`` with decision, answer_status, answer_value, confidence and source_chunk_ids."""
    joined = fields.join(decided, "field_id", "left").withColumn("decision", F.coalesce("decision", F.lit("no_evidence")))
    pick = lambda i: first_match([(F.col("decision") == d, v[i]) for d, v in DECISIONS.items()])
    direct = F.col("decision") == "use_direct_evidence"
    ids = F.when(direct, F.array(F.col("chunk.chunk_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumns({"answer_status": pick(0), "answer_value": F.when(direct, F.col("chunk.answer_value")).otherwise(F.lit(NOT_FOUND)), "confidence": pick(1), "source_chunk_ids": ids})


def numeric(row: dict[str, Column]) -> Column:
    """True for fields that take a number: those of that type and those with a bound."""
    return (row["field_type"] == "number") | row["min"].isNotNull() | row["max"].isNotNull()


def constraint_violations(row: dict[str, Column]) -> Column:
    """Names of the constraints that an answer breaks. A blank answer can only be ``required_missing``.

    row: answer_value, answer_status, field_type, required, regex, options (array), aliases (array), min, max; also
    folded and number, where a column holds the normalised answer and, for numeric fields, its number already.
    Options and aliases are compared as normalised options; pass them normalised.
    """
    value, kind = row["answer_value"], row["field_type"]
    folded = row["folded"] if "folded" in row else T.normalize_text(value)
    number = row["number"] if "number" in row else T.parse_number(folded, folded=True)["value"]
    none = F.array().cast("array<string>")
    allowed = F.concat(F.coalesce(row["options"], none), F.coalesce(row["aliases"], none))
    takes_number = numeric(row)
    missing = F.when(row["required"] & ((row["answer_status"] != "answered") | (folded == "")), "required_missing")
    checks = [
        F.when(F.coalesce(row["regex"], F.lit("")) != "", F.when(~F.regexp_like(F.coalesce(value, F.lit("")), row["regex"]), "regex_mismatch")),
        F.when(F.size(F.coalesce(row["options"], none)) > 0, F.when(~F.array_contains(allowed, T.normalize_enum(folded, folded=True)), "enum_not_allowed")),
        F.when(takes_number & number.isNull(), "number_invalid"),
        F.when(takes_number & (number < row["min"]), "number_below_min"),
        F.when(takes_number & (number > row["max"]), "number_above_max"),
        F.when((kind == "date") & T.parse_date(folded, folded=True).isNull(), "date_invalid"),
        F.when((kind == "bool") & T.normalize_bool(folded, folded=True).isNull(), "bool_invalid"),
    ]
    return F.when(folded == "", F.array_compact(F.array(missing))).otherwise(F.array_compact(F.array(missing, *checks)))


#: The columns that ``constraint_violations`` takes.
CONSTRAINTS = ("answer_value", "answer_status", "field_type", "required", "regex", "options", "aliases", "min", "max")


#: The names that the review path gives to violations.
RENAMED = {"enum_not_allowed": "enum_error", "bool_invalid": "bool_format_error", "number_invalid": "number_format_error", "date_invalid": "date_format_error", "number_below_min": "number_range_error", "number_above_max": "number_range_error"}
FORMATS = ("bool_format_error", "number_format_error", "date_format_error")


def validate(rows: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``rows`` with ``violations``, sorted: constraints under their review names, missing evidence, long or unsure answers.

    rows: the columns of CONSTRAINTS, confidence, source_chunk_ids, must_have_evidence.
    """
    return _validated(rows, "answer_value", T.normalize_text(F.col("answer_value")), "violations", threshold).drop("__folded", "__number")


def _validated(rows: DataFrame, answer: str, folded: Column, name: str, threshold: float) -> DataFrame:
    """``rows`` with the violations of the column ``answer`` as ``name``. Its normalised form and its number are columns, so that they are made once."""
    row = {c: F.col(c) for c in CONSTRAINTS} | {"answer_value": F.col(answer), "folded": F.col("__folded"), "number": F.col("__number")}
    rows = rows.withColumn("__folded", folded)
    rows = rows.withColumn("__number", F.when(numeric(row), T.parse_number(F.col("__folded"), folded=True)["value"]))
    found = constraint_violations(row)
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    answered = F.col("answer_status") == "answered"
    more = F.array(
        F.when(answered & F.col("must_have_evidence") & (F.size("source_chunk_ids") == 0), "missing_evidence"),
        F.when(answered & T.blank(F.col(answer)), "required_missing"),
        F.when(answered & (F.length(answer) > MAX_ANSWER), "answer_too_long"),
        F.when(F.col("confidence") < threshold, "low_confidence"),
    )
    renamed = F.transform(found, lambda v: F.coalesce(F.try_element_at(names, v), v))
    return rows.withColumn(name, F.array_sort(F.array_distinct(F.concat(renamed, F.array_compact(more)))))


#: What each violation calls for; of several, the last in the alphabet counts, so a review goes before a repair.
ACTIONS = {"missing_evidence": "review", "enum_error": "repair", **dict.fromkeys(FORMATS, "repair"), "answer_too_long": "repair"}


def repair_action(attempts: Column, limit: int = 1) -> Column:
    """``repair``, ``review`` or ``none`` for a validated row, by ordered rules."""
    asked = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    # violations are named once, so that Spark makes them once where it puts their expression in their place
    called = F.coalesce(F.array_max(F.transform("violations", lambda v: F.try_element_at(asked, v))), F.lit("none"))
    return first_match([(attempts >= limit, "none"), (F.col("answer_status") != "answered", "review"), (F.col("decision") == "conflict_unresolved", "review")], called)


def repaired(value: Column, folded: Column, field_type: Column, options: Column) -> Column:
    """The value as its type writes it: the first option that holds it or is held by it, 是 or 否, an ISO date; numbers stay.

    folded: a column that holds the value as a normalised option.
    """
    plain = lambda o: F.regexp_replace(F.lower(o), r"[^\p{L}\p{N}%℃°]", "")
    option = F.get(F.filter(options, lambda o: F.contains(folded, plain(o)) | F.contains(plain(o), folded)), F.lit(0))
    truth = T.normalize_bool(folded, folded=True)
    date = F.date_format(T.parse_date(F.regexp_replace(T.collapse(value), "号$", "日")), "yyyy-MM-dd")
    out = first_match([(field_type == "enum", F.coalesce(option, value)), (field_type == "bool", F.coalesce(F.when(truth, "是").when(~truth, "否"), value)), (field_type == "date", F.coalesce(date, value)), (field_type == "number", value)], F.substring(T.collapse(value), 1, MAX_ANSWER))
    return out


def review_reason(status: Column, violations: Column) -> Column:
    """Why a field needs a person, null if it doesn't: conflict, status, violations, in this order."""
    return first_match([(status == "conflict_unresolved", "conflict_unresolved"), (status != "answered", status), (F.size(violations) > 0, F.array_join(violations, ","))], F.lit(None).cast("string"))


def with_options(fields: DataFrame) -> DataFrame:
    """``fields`` with ``options`` and normalised ``aliases``, from ``option_values`` and ``aliases``."""
    out = fields
    for source, name in (("option_values", "options"), ("aliases", "aliases")):
        parts = fields.where(F.size(source) > 0).select("field_id", F.explode(source).alias("v")).withColumn("v", T.normalize_enum(F.col("v"))).groupBy("field_id").agg(F.array_sort(F.collect_set("v")).alias("__n"))
        out = out.drop(*({name} - {source})).join(parts, "field_id", "left").withColumn(name, F.coalesce("__n", F.array().cast("array<string>"))).drop("__n")
    return out


#: Steps of a field's run, in order.
STEPS = ("field_started", "query_planned", "retrieved", "evidence_selected", "predicted", "validated", "repaired", "reviewed", "field_completed")


def run_fields(fields: DataFrame, candidates: DataFrame, threshold: float = 0.65, repairs: int = 1) -> DataFrame:
    """All stages for every field: decision, prediction, validation, one repair at most, review.

    ``fields(field_id, field_type, required, must_have_evidence, regex, option_values, aliases, min, max)``; options
    and aliases are normalised where they are exploded, as a function of Arrow batches can't run inside an array.
    """
    fields = with_options(fields)
    told = predictions(fields, _decided(candidates, "folded"))
    # NOT_FOUND is its own normalised form, the chunk brings that of its answer: no Arrow function before the repair (see metrics.evaluate)
    told = _validated(told, "answer_value", F.when(F.col("decision") == "use_direct_evidence", F.col("chunk.folded")).otherwise(F.lit(NOT_FOUND)), "violations", threshold)
    told = told.withColumn("repair_action", repair_action(F.lit(0), min(1, max(0, repairs))))
    repair = F.col("repair_action") == "repair"
    fixed = repaired(F.col("answer_value"), T.normalize_enum(F.col("__folded"), folded=True), F.col("field_type"), F.col("option_values"))
    # an answer that stays keeps its violations; only repaired ones are validated again
    again = _validated(told.withColumn("__fixed", F.when(repair, fixed)), "__fixed", T.normalize_text(F.col("__fixed")), "__again", threshold)
    again = again.withColumns({"chunk": F.col("chunk").dropFields("folded"), "answer_value": F.when(repair, F.col("__fixed")).otherwise(F.col("answer_value")), "violations": F.when(repair, F.col("__again")).otherwise(F.col("violations"))})
    return again.drop("__folded", "__number", "__fixed", "__again").withColumn("review_reason", review_reason(F.col("answer_status"), F.col("violations")))


def trace(rows: DataFrame, run_id: str) -> DataFrame:
    """The events of every field's run, in order: run_id, field_id, seq, step, status, payload.

    A field is ``repaired`` or ``reviewed`` only if it was.
    """
    payload = F.to_json(F.struct("decision", "answer_status", "repair_action", "review_reason"))
    happened = {"repaired": F.col("repair_action") == "repair", "reviewed": F.col("review_reason").isNotNull()}
    steps = F.array_compact(F.array(*[F.when(happened[s], F.lit(s)) if s in happened else F.lit(s) for s in STEPS]))
    return rows.select(F.lit(run_id).alias("run_id"), "field_id", F.posexplode(steps).alias("seq", "step"), F.col("answer_status").alias("status"), payload.alias("payload"))


def trace_summary(events: DataFrame) -> DataFrame:
    """Counts over ``events(field_id, step, status)``: events, distinct fields, completed, repaired and reviewed."""
    done = F.col("step") == "field_completed"
    return events.agg(F.count("*").alias("n_events"), F.count_distinct("field_id").alias("n_fields"), F.count_if(done).alias("n_completed"), F.count_if(done & (F.col("status") == "answered")).alias("n_answered"), F.count_if(F.col("step") == "repaired").alias("n_repaired"), F.count_if(F.col("step") == "reviewed").alias("n_reviewed"))


def merge_reviews(agent: DataFrame, writeback: DataFrame) -> DataFrame:
    """Both lists; of the same field and reason the agent's row stays."""
    both = agent.withColumn("origin", F.lit("agent")).unionByName(writeback.withColumn("origin", F.lit("writeback")))
    return both.groupBy("field_id", "reason").agg(F.min("origin").alias("origin"))
