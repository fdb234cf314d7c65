"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Groups per shard for slot numbers. A fixed number: offsets are ``shards x SLOT_BUCKETS`` rows at most.
SLOT_BUCKETS = 1024
#: Stands for a null key, so that all rows without a key share one shard.
NULL_KEY = "\x00null"


def scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of each shard's score for the key: ``-weight / ln(u)``, ``u`` in (0, 1) from the hash of key and shard.

    The shard with the largest score wins. Each score depends on the key and its own shard alone, so adding a
    shard moves only the keys that the new shard wins. Shards of weight 0 or less never win.
    """
    name = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    listed = F.array(*[F.lit(float(w)) for w in weights])

    def one(weight: Column, i: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(name, F.lit(":"), i.cast("string"))), 12)
        unit = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.when(weight > 0, -weight / F.ln(unit)).otherwise(F.lit(float("-inf")))

    return F.transform(listed, one)


def shard_of(score: Column) -> Column:
    """Position of the largest score; the lower shard wins ties."""
    return (F.array_position(score, F.array_max(score)) - 1).cast("int")


def with_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """``df`` with the shard of each row, and in ``grown`` the shard if one more of ``grown_weight`` were there.

    Nulls in the key share one shard; repeated keys share theirs. The two columns replace columns of these names.
    An empty table gives an empty table.
    """
    if not weights or max(weights) <= 0:
        raise ValueError("at least one shard needs a positive weight")
    all_scores = scores(F.col(key), [*weights, grown_weight])
    n = len(weights)
    out = df.withColumn("__scores", all_scores).withColumn(shard, shard_of(F.slice("__scores", 1, n)))
    if grown:
        out = out.withColumn(grown, shard_of(F.col("__scores")))
    return out.drop("__scores")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard.

    Equal rows are counted before they are shuffled, then rows are numbered in ``buckets`` groups a shard and
    each group starts where the last ended. So no task sorts a whole shard, however few the shards are, and a
    row that repeats without bound is one row of a window. ``rows`` is read twice; it should be a stored table.
    """
    columns = rows.columns
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    group = [shard, "__bucket"]
    by_bucket = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x buckets rows, so it can be broadcast at any input size
    starts = bucketed.groupBy(*group).agg(F.count("*").alias("__n")).select(*group, F.coalesce(F.sum("__n").over(by_bucket), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = bucketed.groupBy(*columns, "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = counted.withColumnRenamed(shard, "__s").withColumnRenamed("__bucket", "__b")
    joined = placed.join(F.broadcast(starts), (placed["__s"] == starts[shard]) & (placed["__b"] == starts["__bucket"]))
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(*columns, (F.col("__start") + F.col("__before") + F.col("__i")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """A shard and slot for every row of ``docs(doc_id, text)``, by the law ``key``.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, law, shard, slot, grown_shard.
    A null doc_id is a key like any other; rows with the same doc_id share a shard and have slots of their own;
    other columns are ignored. Null texts count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = materialise(with_shards(rows, "doc_id", list(weights or [1.0] * n_shards), "shard", "grown_shard"))
    slots = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
