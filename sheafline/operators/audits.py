"""Audit cases, candidate classes and short reports, from rules given as data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match

#: Severities from worst.
SEVERITIES = ("high", "medium", "low")


@dataclass(frozen=True)
class Rule:
    """A case that each row gives for which ``holds``, an SQL condition, is true."""

    need_type: str
    severity: str
    holds: str
    reason: str
    action: str = ""


def cases(rows: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One case for every rule that a row meets: the keys, need_type, severity, reason, suggested_action, severity_rank."""
    made = [F.when(F.expr(r.holds), F.struct(F.lit(r.need_type).alias("need_type"), F.lit(r.severity).alias("severity"), F.lit(r.reason).alias("reason"), F.lit(r.action).alias("suggested_action"))) for r in rules]
    found = rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("c")).select(*keys, "c.*")
    return found.withColumn("severity_rank", first_match([(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)], len(SEVERITIES)))


def classified(candidates: DataFrame, rules: Sequence[tuple[str, str, str]], otherwise: str = "other") -> DataFrame:
    """``candidates`` with category and group by ordered (category, group, pattern) over anchor and header; the first that matches counts."""
    text = F.concat_ws(" ", "anchor", "header_sample")
    category = first_match([(text.rlike(p), c) for c, _, p in rules], otherwise)
    group = first_match([(F.col("table_category") == c, g) for c, g, _ in rules], otherwise)
    return candidates.withColumn("table_category", category).withColumn("source_group", group)


def selected(candidates: DataFrame, policy: str = "recommended", category: str | None = None, recommended: Sequence[str] = ()) -> DataFrame:
    """The candidates of a policy: ``all``, ``recommended`` groups, or one ``category``."""
    if policy == "category":
        return candidates.where(F.col("table_category") == category)
    return candidates if policy == "all" else candidates.where(F.col("source_group").isin(*recommended))


def value_like(values: Column) -> Column:
    """True if at least half of a header's cells, and one at least, look like values: numbers, dates or long texts."""
    looks = F.size(F.filter(values, lambda v: v.rlike(r"^\s*[-+]?[\d.,/:%年月日]+\s*$") | (F.length(v) > 30)))
    return looks >= F.greatest(F.lit(1), F.floor(F.size(values) / 2))


def report(rows: DataFrame, columns: Sequence[str], order: Sequence[str], limit: int = 50) -> str:
    """The first ``limit`` rows as a Markdown table; a report is short by its nature."""
    shown = rows.orderBy(*order).limit(limit).select(*[T.markdown_cell(F.col(c)).alias(c) for c in columns]).collect()
    lines = [columns, ["---"] * len(columns), *[[r[c] or "" for c in columns] for r in shown]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"
