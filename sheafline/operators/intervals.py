"""Points and ranges joined by equality: no range is spread over its points, and no point meets a range that is not near.

A range belongs to the level of its length, the least power of two that holds it, and stands in the one or two buckets
of that width that it touches. A point looks up the one bucket of each level that is in use, so a pair meets in one place
only. Wide keys split by their buckets, and what the lookup finds is checked.

Whether any range covers a place needs no pairs: it is whether the furthest end of the ranges that begin at or before it
reaches it. That is a running maximum in buckets of places, each of which starts from what earlier buckets reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the places that stand in one bucket where ends are carried: a task sorts no more whole places of a key at once.
PLACES = 16


def _level(first: Column, last: Column) -> Column:
    """Bits of the length less one: a bucket of so many bits is as wide as the range."""
    length = last.cast("long") - first.cast("long")
    return F.when(length == 0, 0).otherwise(F.length(F.bin(length)))


def _bucket(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def _placed(ranges: DataFrame, first: str, last: str) -> DataFrame:
    held = ranges.where(F.col(first) <= F.col(last)).withColumn("__level", _level(F.col(first), F.col(last)))
    ends = F.array_distinct(F.array(_bucket(F.col(first), F.col("__level")), _bucket(F.col(last), F.col("__level"))))
    return held.withColumn("__bucket", F.explode(ends))


def interval_pairs(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, last: str, how: str = "inner") -> DataFrame:
    """Each row of ``points`` with each row of ``ranges`` of equal ``keys`` for which first <= at <= last; ``how`` may be left_semi.

    Nulls in keys, at, first or last match nothing, nor do ranges that end before they begin. Columns of ``ranges`` other
    than the keys must have names of their own. Rows that repeat pair as often as they do.
    """
    placed = _placed(ranges, first, last)
    levels = sorted(r[0] for r in placed.select("__level").distinct().collect())  # 64 at most
    if not levels:
        levels = [0]
    looked = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("__bucket", _bucket(F.col(at), F.col("__level")))
    placed = placed.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__level", "__bucket"]})
    on = (F.col("__level") == F.col("__r___level")) & (F.col("__bucket") == F.col("__r___bucket")) & F.col(at).between(F.col(first), F.col(last))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    # sizes of files don't tell how many ranges they hold: a broadcast of them could fill the driver
    joined = looked.join(placed.hint("merge"), on, how)
    return joined.drop("__level", "__bucket", "__r___level", "__r___bucket", *(f"__r_{k}" for k in keys))


def _starts(ranges: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """``keys, __bucket, __at, __last``: the furthest end of the ranges that begin at a place."""
    held = ranges.where(first <= last).groupBy(*keys, first.alias("__at")).agg(F.max(last).alias("__last"))
    return held.withColumn("__bucket", _bucket(F.col("__at"), F.lit(PLACES)))


def _carried(starts: DataFrame, keys: Sequence[str], buckets: DataFrame | None = None) -> DataFrame:
    """``starts`` and, for each bucket of them and of ``buckets(keys, __bucket)``, a row without ``__at``: how far the buckets before it reach."""
    most = starts.groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    if buckets is not None:
        most = most.unionByName(buckets, allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    before = F.max("__last").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    return starts.unionByName(most.withColumn("__last", before).where("__last is not null"), allowMissingColumns=True)


def covered(places: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, flag: str, first: str = "first", last: str = "last") -> DataFrame:
    """``places`` with ``flag``: whether any range of equal keys covers them; false where a key or the place is null.

    Every row is shuffled once, with no others of its place put together before; rows of a place that repeats often are
    for ``with_cover``.
    """
    starts = _starts(ranges.where(" and ".join(f"`{c}` is not null" for c in keys)), keys, F.col(first), F.col(last))
    asked = places.withColumns({"__at": F.col(at), "__bucket": _bucket(F.col(at), F.lit(PLACES)), "__asks": F.lit(True)})
    rows = asked.unionByName(_carried(starts, keys, asked.select(*keys, "__bucket").distinct()), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "__bucket").orderBy(F.col("__at").asc_nulls_first(), F.col("__asks").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn(flag, F.coalesce(F.max("__last").over(upto) >= F.col("__at"), F.lit(False)))
    return told.where("__asks").drop("__at", "__bucket", "__asks", "__last")


def with_cover(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, flag: str, first: str = "first", last: str = "last") -> DataFrame:
    """``points`` with ``flag``: whether any range of equal keys covers them; false where a key or the place is null.

    Only distinct places are looked up, and each comes back once, however many ranges cover it.
    """
    places = points.select(*keys, at).where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).distinct()
    hit = covered(places, ranges, keys, at, flag, first, last).where(flag)
    return points.join(hit, [*keys, at], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def covered_length(ranges: DataFrame, keys: Sequence[str], name: str, first: str = "first", last: str = "last") -> DataFrame:
    """``keys, name``: how many whole numbers the ranges of a key cover, those that overlap counted once."""
    held = _carried(_starts(ranges, keys, F.col(first).cast("long"), F.col(last).cast("long")), keys)
    reached = F.max("__last").over(Window.partitionBy(*keys, "__bucket").orderBy(F.col("__at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0).cast("long"), F.col("__last") - F.greatest(F.col("__at"), F.coalesce(reached + 1, F.col("__at"))) + 1)
    return held.withColumn("__own", own).where("__at is not null").groupBy(*keys).agg(F.sum("__own").alias(name))
