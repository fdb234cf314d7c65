"""Resolvers of table candidates: one expression set over a table of specifications, and the few that need more.

Rows are ``(table_id, category, row, values)``. A specification says where the header and the data are, the fixed
header names if there are any, how rows are grouped, and which role their segments have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import carry_forward, first_match


@dataclass(frozen=True)
class Spec:
    """How tables of a category are read. ``shape``: ``header`` (names from a row or fixed), ``pairs`` (key and value by turns), ``statement`` (one text a row), ``steps`` (numbered), ``transpose`` (columns are rows) or ``schema`` (names only)."""

    category: str
    shape: str = "header"
    header_row: int = 1
    data_start: int = 2
    headers: tuple[str, ...] = ()
    role: str = "data_row"
    grouped: bool = False
    aggregate: bool = False
    fill_first: bool = False


def _literal(specs: Sequence[Spec], pick, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for s in specs:
        value = pick(s)
        value = F.array(*[F.lit(v) for v in value]).cast(kind) if isinstance(value, tuple) else F.lit(value).cast(kind)
        out = F.when(F.col("category") == s.category, value).otherwise(out)
    return F.coalesce(out, (F.array().cast(kind) if kind.startswith("array") else F.lit(pick(Spec(""))).cast(kind)))


def resolve(rows: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Segments ``table_id, category, row, role, group, text, fallback`` of all tables; categories without a spec take the default.

    A row with a single value, in a grouped table, names the group of the rows below. In a table that is filled a
    blank first cell takes the value above, or the next below where there is none above. Blank rows give nothing.
    """
    named = rows.withColumns({
        "shape": _literal(specs, lambda s: s.shape, "string"), "header_row": _literal(specs, lambda s: s.header_row, "int"), "data_start": _literal(specs, lambda s: s.data_start, "int"),
        "fixed": _literal(specs, lambda s: s.headers, "array<string>"), "role": _literal(specs, lambda s: s.role, "string"),
        "grouped": _literal(specs, lambda s: s.grouped, "boolean"), "fill_first": _literal(specs, lambda s: s.fill_first, "boolean"),
    })
    kept = F.filter("values", lambda v: ~T.blank(v))
    head = F.max(F.when(F.col("row") == F.col("header_row"), F.col("values"))).over(Window.partitionBy("table_id"))
    named = named.withColumns({"n": F.size(kept), "head": F.when(F.size("fixed") > 0, F.col("fixed")).otherwise(head)})
    single = F.when((F.col("n") == 1) & F.col("grouped"), T.collapse(kept[0]))
    named = named.withColumn("group", F.when(F.col("grouped"), carry_forward(single, ["table_id"], ["row"])))
    first = F.when((F.col("row") >= F.col("data_start")) & ~T.blank(F.get("values", F.lit(0))), F.get("values", F.lit(0)))
    named = named.withColumn("first", F.when(F.col("fill_first"), carry_forward(first, ["table_id"], ["row"], look_ahead=True)))
    data = named.where((F.col("row") >= F.col("data_start")) & (F.col("n") > 0) & ~(F.col("grouped") & (F.col("n") == 1)))
    values = F.when(F.col("fill_first"), F.concat(F.array("first"), F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0))))).otherwise(F.col("values"))
    data = data.withColumn("values", values)
    step = F.row_number().over(Window.partitionBy("table_id").orderBy("row"))
    body = first_match([
        (F.col("shape") == "pairs", T.alternating_pairs(F.col("values"))), (F.col("shape") == "statement", F.array_join(F.transform(F.filter("values", lambda v: ~T.blank(v)), T.collapse), " ")),
        (F.col("shape") == "steps", F.concat(step.cast("string"), F.lit(". "), F.array_join(F.transform(F.filter("values", lambda v: ~T.blank(v)), T.collapse), " "))),
    ], T.pair_values(F.col("head"), F.col("values")))
    fallback = (F.col("shape") == "header") & F.exists(F.sequence(F.lit(0), F.size("values") - 1), lambda i: ~T.blank(F.get(F.col("values"), i)) & T.blank(F.get(F.col("head"), i)))
    plain = data.where(~F.col("shape").isin("transpose", "schema")).select("table_id", "category", "row", "role", "group", F.concat_ws("：", "group", body).alias("text"), F.coalesce(fallback, F.lit(False)).alias("fallback"))
    names = named.where("shape = 'schema' and row = header_row").select("table_id", "category", "row", F.lit("schema").alias("role"), "group", F.array_join(F.transform(kept, T.collapse), "；").alias("text"), F.lit(False).alias("fallback"))
    return plain.unionByName(names).unionByName(transposed(named.where("shape = 'transpose'")))


def transposed(rows: DataFrame) -> DataFrame:
    """Each column after the first as a segment; the first column holds the names."""
    cells = rows.select("table_id", "category", "role", "group", "row", T.collapse(F.get("values", F.lit(0))).alias("name"), F.posexplode("values").alias("col", "value")).where("col > 0")
    pairs = cells.where(~T.blank(F.col("value"))).groupBy("table_id", "category", "role", "group", "col").agg(F.array_sort(F.collect_list(F.struct("row", F.concat_ws("：", "name", T.collapse(F.col("value"))).alias("pair")))).alias("ps"))
    return pairs.select("table_id", "category", F.col("col").alias("row"), "role", "group", F.array_join("ps.pair", "；").alias("text"), F.lit(False).alias("fallback"))


def aggregates(segments: DataFrame, categories: Sequence[str] | None, role: str = "procedure", title: str | None = None) -> DataFrame:
    """One segment for each table of these categories (None: all): its texts in order, numbered.

    Texts are joined by line ends or, behind a title, by ``；``.
    """
    own = segments if categories is None else segments.where(F.col("category").isin(*categories))
    numbered = own.withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy("row")))
    lines = F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("k").cast("string"), F.lit(". "), F.col("text")).alias("line"))))
    text = F.array_join("ls.line", "\n") if title is None else F.concat(F.lit(f"{title}："), F.array_join("ls.line", "；"))
    return numbered.groupBy("table_id", "category").agg(lines.alias("ls")).where(F.size("ls") > 1).select("table_id", "category", F.lit(0).alias("row"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("group"), text.alias("text"), F.lit(False).alias("fallback"))


def table_status(rows: DataFrame, segments: DataFrame, skips: DataFrame) -> DataFrame:
    """``table_id, n_segments, status, confidence``: nothing found, names only, rows left over, or resolved.

    ``skips(table_id, row)`` are rows that a resolver left out for a known reason.
    """
    left = rows.select("table_id", "row").join(segments.select("table_id", "row"), ["table_id", "row"], "left_anti").join(skips.select("table_id", "row"), ["table_id", "row"], "left_anti")
    unknown = left.groupBy("table_id").agg(F.count("*").alias("unknown"))
    found = segments.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "schema").alias("schemas"), F.max("fallback").alias("fallback"))
    joined = rows.select("table_id").distinct().join(found, "table_id", "left").join(unknown, "table_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = first_match([(n == 0, "no_segments"), (F.col("schemas") == n, "schema_only"), (F.coalesce("unknown", F.lit(0)) > 0, "needs_review")], "resolved")
    sure = first_match([(status.isin("no_segments", "needs_review"), "low"), (status == "schema_only", "medium"), (F.col("fallback"), "medium")], "high")
    return joined.select("table_id", n.alias("n_segments"), status.alias("status"), sure.alias("confidence"))


def without_repeats(values: Column) -> Column:
    """Values without those that equal the one before them."""
    return F.filter(values, lambda v, i: (i == 0) | (v != F.get(values, i - 1)))


def optical_specs(rows: DataFrame, attribute: str = "属性", described: tuple[str, ...] = ("描述", "描述："), distance: str = "传输距离") -> DataFrame:
    """Segments ``table_id, row, role, group, text`` of tables of module specifications ``(table_id, row, values)``.

    The second row names variants, some of them twice; a row of one value names the group of the rows below; a row
    of distances gives their options and the headers of the rows below. A row as wide as the second has the values
    of a variant's columns put together, each value once. What is carried down are windows over the table's rows.
    """
    value = F.transform("values", T.collapse)
    kept = F.filter("value", lambda v: v != "")
    distinct = without_repeats(F.col("kept"))
    named = rows.withColumn("value", value).withColumn("kept", kept).withColumn("distinct", distinct)
    head = (F.size("distinct") == 2) & (F.col("distinct")[0] == attribute) & F.col("distinct")[1].isin(*described)
    kind = first_match([(F.size("kept") == 0, "blank"), (head, "header"), (F.size("distinct") == 1, "group"), (F.col("row") == 2, "variants"), ((F.col("distinct")[0] == distance) & (F.size("distinct") > 2), "distances")], "data")
    named = named.withColumn("kind", kind)
    by = (["table_id"], ["row"])
    named = named.withColumns({
        "group": carry_forward(F.when(F.col("kind") == "group", F.col("distinct")[0]).when(F.col("kind") == "variants", F.array_join("distinct", "/")), *by),
        "headers": carry_forward(F.when(F.col("kind") == "variants", F.concat(F.array(F.lit(attribute)), "distinct")).when(F.col("kind") == "distances", F.concat(F.array(F.lit(attribute)), F.slice("distinct", 2, F.size("distinct")))), *by),
        "variants": carry_forward(F.when(F.col("kind") == "variants", F.filter(F.slice("value", 2, F.greatest(F.size("value") - 1, F.lit(0))), lambda v: v != "")), *by),
    })
    wide = F.coalesce(F.size("value") - 1 == F.size("variants"), F.lit(False))

    def merged(variant: Column) -> Column:
        own = F.filter(F.transform(F.col("variants"), lambda x, i: F.when(x == variant, F.get(F.col("value"), i + 1))), lambda v: v.isNotNull() & (v != ""))
        return F.array_join(F.array_distinct(own), "、")

    names = without_repeats(F.col("variants"))
    together = T.pair_values(F.concat(F.array(F.lit(attribute)), names), F.concat(F.array(F.col("value")[0]), F.transform(names, merged)))
    text = F.when(F.col("kind") == "distances", F.concat(F.lit(f"{distance}选项："), F.array_join(F.slice("distinct", 2, F.size("distinct")), "、"))).when(wide, together).otherwise(T.pair_values(F.coalesce("headers", F.array().cast("array<string>")), F.col("distinct")))
    role = F.when(F.col("kind") == "distances", "distance_options").otherwise("data_row")
    return named.where(F.col("kind").isin("distances", "data")).select("table_id", "row", role.alias("role"), "group", text.alias("text"))
