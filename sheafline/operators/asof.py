"""As-of joins: each row with the last row of the other side that isn't later, in buckets, so that a hot key is many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], width: int) -> DataFrame:
    """``left`` with ``values`` and ``<at>_matched`` of the last row of ``right`` of the same keys whose ``at`` isn't later.

    ``at`` is a whole number on both sides. Of rows of ``right`` with the same keys and ``at`` the one with the greatest
    values counts. Rows of ``left`` that nothing precedes, or with a null key or ``at``, have nulls; rows of ``right``
    with such nulls match nothing. All rows of ``left`` stay, repeated ones too; the columns ``values`` must be new to it.

    Each side is cut into buckets ``width`` wide. A row sees its own bucket through a window over both sides, and all
    earlier ones through one row a bucket, the last of the bucket carried on. So no task holds or sorts more of a
    key than a bucket, and what is carried on is as many rows as a key has buckets.
    """
    bucket = F.floor(F.col(at) / F.lit(width)).alias("__bucket")
    value = F.struct(F.col(at).alias("at"), *values)
    absent = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    mine = left.select(F.struct(*left.columns).alias("__row"), *[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), bucket, F.lit(1).alias("__side"), absent.alias("__seen"))
    known = right.where(F.col(at).isNotNull()).dropna(subset=list(keys))
    theirs = known.select(F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), *[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), bucket, F.lit(0).alias("__side"), value.alias("__seen"))
    names = [f"__{k}" for k in keys]
    inside = Window.partitionBy(*names, "__bucket").orderBy("__at", "__side", "__seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of the left without a key or time meet nothing; they take no part in the shuffle
    whole = F.col("__at").isNotNull()
    for k in names:
        whole = whole & F.col(k).isNotNull()
    placed = mine.where(whole).unionByName(theirs).withColumn("__near", F.last("__seen", ignorenulls=True).over(inside)).where("__side = 1")

    ends = theirs.groupBy(*names, "__bucket").agg(F.max("__seen").alias("__last"))
    wanted = mine.where(whole).select(*names, "__bucket").distinct().withColumn("__last", absent)
    both = ends.unionByName(wanted).groupBy(*names, "__bucket").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("__far", F.last("__last", ignorenulls=True).over(before)).where(F.col("__far").isNotNull()).drop("__last")

    seen = F.coalesce("__near", "__far")
    told = placed.join(carried, [*names, "__bucket"], "left").select("__row", seen.alias("__seen"))
    told = told.unionByName(mine.where(~whole).select("__row", "__seen"))
    return told.select("__row.*", *[F.col(f"__seen.{v}").alias(v) for v in values], F.col("__seen.at").alias(f"{at}_matched"))


def present(*values: Column) -> Column:
    """The first of ``values`` that is neither null nor empty, as text."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])
