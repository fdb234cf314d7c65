"""Operators on the order of rows: first and last of a key, carried values, heading stacks, ordered rules.

Order is always an explicit column, never the order in which rows happen to be read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by an aggregate that combines before it shuffles."""
    return _extreme(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def carry_forward(value: Column, within: Sequence[str], order: Sequence[str], look_ahead: bool = False) -> Column:
    """The last value so far that isn't null; with ``look_ahead`` the next one where there is none so far."""
    so_far = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = F.last(value, ignorenulls=True).over(so_far)
    if look_ahead:
        onward = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        out = F.coalesce(out, F.first(value, ignorenulls=True).over(onward))
    return out


def heading_paths(blocks: DataFrame, doc: str, order: str, level: str, text: str, deepest: int | None = None, width: int = 4096) -> DataFrame:
    """``blocks`` with ``heading_path``, the headings above each block.

    A heading of level L keeps the first L-1 entries of the path so far and adds itself; rows of no level are
    below the path so far. Entries are cut by place, so a skipped level leaves the path shorter than the level.
    All rows stay. A heading without a text is a null entry; rows of the same place in a document go by level and text;
    rows without a document are one document, rows without a place its first ones. ``deepest`` is a bound on levels,
    counted where it isn't given.

    A heading's place in the path is its level or one more than the path was long, whichever is less, so over the
    headings 1, 2, ... n of a document the path is as long as n plus the least of 0 and all level - number so far: a running
    minimum, and its entries are the last heading of each place. Both are taken in buckets ``width`` wide of the order
    column, and earlier buckets are one carried row each, so no task sorts more of a document than a bucket.
    """
    if deepest is None:
        deepest = blocks.agg(F.max(level)).first()[0] or 0
    titled, place = F.col(level) > 0, F.col("__skip") + F.col("__n") + F.least(F.col("__floor"), F.col("__low") - F.col("__skip"))
    inside = Window.partitionBy("__key").orderBy(order, level, text).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__key.doc").orderBy("__key.bucket").rowsBetween(Window.unboundedPreceding, -1)

    cut = blocks.withColumn("__key", F.struct(F.col(doc).alias("doc"), F.floor(F.col(order) / F.lit(width)).alias("bucket")))
    near = cut.withColumn("__n", F.count(F.when(titled, 1)).over(inside)).withColumn("__low", F.min(F.when(titled, F.col(level) - F.col("__n"))).over(inside))
    sums = near.groupBy("__key").agg(F.max("__n").alias("__count"), F.min("__low").alias("__least")).withColumn("__skip", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    sums = sums.withColumn("__floor", F.least(F.lit(0), F.min(F.col("__least") - F.col("__skip")).over(before))).select("__key", "__skip", "__floor")
    placed = near.join(sums, "__key").withColumn("__place", place)

    entry, places = F.struct(F.col(text).alias("t")), range(1, int(deepest) + 1)
    own = [titled & (F.col("__place") == p) for p in places]
    ends = placed.groupBy("__key").agg(F.lit(0).alias("__none"), *[F.max_by(entry, F.when(o, F.struct(order, level, text))).alias(f"__end{p}") for p, o in zip(places, own, strict=True)])
    far = ends.select("__key", *[F.last(f"__end{p}", ignorenulls=True).over(before).alias(f"__far{p}") for p in places])
    told = placed.withColumns({f"__near{p}": F.last(F.when(o, entry), ignorenulls=True).over(inside) for p, o in zip(places, own, strict=True)}).join(far, "__key")
    entries = F.array(*[F.coalesce(f"__near{p}", f"__far{p}")["t"] for p in places]).cast("array<string>")
    return told.select(*blocks.columns, F.slice(entries, F.lit(1), F.col("__place").cast("int")).alias("heading_path"))


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None))
    for holds, value in rules:
        out = out.when(holds, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def round_robin(df: DataFrame, group: str, order: Sequence[str], per_group: int, total: int) -> DataFrame:
    """At most ``per_group`` rows of each group and ``total`` in all, groups taking turns; for reports and samples."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= per_group)
    return ranked.orderBy("turn", group).limit(total)


def half_even_rank(values: Column, share: float) -> Column:
    """The entry of a sorted array at ``share`` of its length, the place rounded half to even; null if empty."""
    place = F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int")
    return F.get(F.array_sort(values), place)


def changed(base: DataFrame, improved: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Rows of the same key in two methods' results, with the ``flags`` that only the improved one has."""
    a = base.select(F.col(key), *[F.col(f).alias(f"base_{f}") for f in flags])
    b = improved.select(F.col(key), *[F.col(f).alias(f"new_{f}") for f in flags])
    reasons = F.array_compact(F.array(*[F.when(F.col(f"new_{f}") & ~F.col(f"base_{f}"), F.lit(f)) for f in flags]))
    return a.join(b, key).withColumn("reasons", reasons).where(F.size("reasons") > 0)
