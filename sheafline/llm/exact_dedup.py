"""Exact dedup by a minimal perfect hash over the distinct digests that have been seen before.

A first pass hashes every whole text and keeps the log of digests seen more than once, together with any
history from earlier deliveries. The log is cut into shards by digest; each shard gets a minimal perfect hash
whose slots hold the full digest and the winner's locator. A second pass sends each row to its shard, computes
its slot and compares the digest in the slot byte by byte: a match is a member, and the slot names the row that
stays. Rows that are no members are grouped by digest on their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Digests in a shard of the index, on average. Bounds the memory of a task that builds or probes one.
SHARD_KEYS = 20_000
#: Rows that probe one shard together, on average; more are dealt to several tasks by a salt.
PROBES = 40_000
#: Bits for each key that is left, on each level of the hash.
GAMMA = 2
INDEX = "shard int, n long, levels array<binary>, digests binary, keeps binary, sizes binary"


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _lane(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """Position of each key on a level. keys: the digests as four 64-bit words; their bits are uniform already."""
    with np.errstate(over="ignore"):
        x = keys[:, level & 3] ^ (np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(m)).astype(np.int64)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits; each key owns a bit alone on the first level where nothing else that is left falls on it.

    ``keys`` are distinct. The number of set bits equals the number of keys, so a bit's rank is a minimal
    perfect hash. Levels are added until every key has a bit; about ``GAMMA`` bits a key and level.
    """
    levels, left = [], keys
    while len(left):
        m = max(64, GAMMA * len(left))
        at = _lane(left, len(levels), m)
        alone = np.bincount(at, minlength=m) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("the keys of a perfect hash must be distinct")
    return levels


def mph_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has a bit for it. Keys that were not built in may get any slot."""
    slots, start, left = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for k, bits in enumerate(levels):
        at = _lane(keys[left], k, len(bits))
        ranks, hit = np.cumsum(bits) - 1, bits[at]
        slots[left[hit]] = start + ranks[at[hit]]
        start, left = start + int(bits.sum()), left[~hit]
    return slots


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _build(group: pa.Table) -> pa.Table:
    keys = _words(group["digest"])
    levels = build_mph(keys)
    order = np.argsort(mph_slots(levels, keys))
    plain = {"shard": [group["shard"][0].as_py()], "n": [len(keys)], "levels": [[np.packbits(b).tobytes() + len(b).to_bytes(8, "little") for b in levels]]}
    kept = {"digests": [keys[order].tobytes()], "keeps": [group["keep_id"].to_numpy()[order].astype("<i8").tobytes()], "sizes": [group["group_size"].to_numpy()[order].astype("<i8").tobytes()]}
    return pa.table(plain | kept, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("levels", pa.list_(pa.binary())), ("digests", pa.binary()), ("keeps", pa.binary()), ("sizes", pa.binary())]))


def _level(stored: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(stored[:-8], np.uint8), count=int.from_bytes(stored[-8:], "little")).astype(bool)


def _probe(index: pa.Table, rows: pa.Table) -> pa.Table:
    keys = _words(rows["digest"])
    member = np.zeros(len(keys), bool)
    keep, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if index.num_rows and len(keys):
        entry = index.slice(0, 1).to_pylist()[0]
        slots = mph_slots([_level(b) for b in entry["levels"]], keys)
        found = slots >= 0
        held = np.frombuffer(entry["digests"], np.uint64).reshape(-1, 4)
        member[found] = (held[slots[found]] == keys[found]).all(1)  # the byte check: all 32 bytes
        keep[member] = np.frombuffer(entry["keeps"], "<i8")[slots[member]]
        size[member] = np.frombuffer(entry["sizes"], "<i8")[slots[member]]
    none = ~member
    return pa.table({"doc_id": rows["doc_id"], "digest": rows["digest"], "keep_id": pa.array(keep, mask=none), "group_size": pa.array(size, mask=none)}, schema=pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())]))


def build_index(digests: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """The stored index over ``digests(digest, keep_id, group_size)``, one row a shard, and its number of shards.

    ``digest`` is distinct and 32 bytes. ``n_keys`` is their number; it sets the number of shards.
    """
    shards = max(1, -(-n_keys // SHARD_KEYS))
    keyed = digests.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    return materialise(keyed.groupBy("shard").applyInArrow(_build, INDEX)), shards


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, digest (32 bytes).

    Texts are equal when identical; null counts as empty, so null and empty texts are one group. Of equal texts
    the row with the largest doc_id stays; a null doc_id is smaller than any other, and a group that has no
    other id has a null keep_id and keeps its rows. Rows that repeat the winner's doc_id are all marked kept.
    ``history(digest, keep_id, group_size)`` adds digests of earlier deliveries, one row each; there the larger
    doc_id wins too and sizes add up. Other columns are ignored; an empty table gives an empty table.
    """
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest")))
    seen = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    log = seen.where((F.col("group_size") > 1) & F.col("keep_id").isNotNull())
    if history is not None:
        past = history.select("digest", F.col("keep_id").cast("long"), F.col("group_size").cast("long"))
        both = seen.unionByName(past.withColumn("past", F.lit(1)), allowMissingColumns=True).groupBy("digest")
        log = both.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("past").alias("past")).where(((F.col("group_size") > 1) | F.col("past").isNotNull()) & F.col("keep_id").isNotNull()).drop("past")
    log = materialise(log)
    index, shards = build_index(log, log.count())

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")).withColumn("at", F.monotonically_increasing_id())
    # one row a shard: 1/SHARD_KEYS of the log; the busy ones are split by a salt, the index row goes to each part
    load = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))
    salted = dealt.join(load, "shard").withColumn("salt", F.pmod(F.col("at"), F.col("parts")).cast("int")).select("shard", "salt", "doc_id", "digest")
    spread = index.join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "salt", "levels", "digests", "keeps", "sizes")
    probed = materialise(spread.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(_probe, "doc_id long, digest binary, keep_id long, group_size long"))

    members = probed.where("group_size is not null")
    others = probed.where("group_size is null").select("doc_id", "digest")
    alone = others.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = others.join(alone, "digest").select("doc_id", "digest", "keep_id", "group_size")
    every = members.select("doc_id", "digest", "keep_id", "group_size").unionByName(grouped)
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its own columns: one of each group of equal texts."""
    kept = dedup(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("__n"))
    winners = materialise(kept)
    keyed = docs.withColumn("__digest", digest_of(F.col("text")))
    one = keyed.join(winners, F.col("doc_id").eqNullSafe(F.col("__id")) & (keyed["__digest"] == winners["__digest"]), "left_semi")
    if not winners.where("__n > 1").isEmpty():  # rows that repeat id and text; else the texts need no second shuffle
        one = one.dropDuplicates(["doc_id", "__digest"])
    return one.select(*docs.columns)


def digest_hex(text: str | None) -> str:
    """What ``text_sha256`` holds for a text; used by tests."""
    return hashlib.sha256((text or "").encode()).hexdigest()
