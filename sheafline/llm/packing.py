"""Packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

Pieces of full length are sequences of their own. The others are dealt evenly into blocks of bounded size. Pieces
of equal length are interchangeable, so a block is a table of lengths and counts, and a packing is a list of bins
of lengths. Several islands evolve packings of the same block apart from one another, all from random ones: crossover
injects whole full bins of one parent into another, bins that would repeat a piece are dissolved, and what they held
is put back by best fit. After each round the best packing of each island migrates to the next island. In the end
the best packing of each block is dealt back to the pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import VOCABULARY, by_rank, encode_ids, tokenizer

CAPACITY = 1024
#: Ends every document.
END = 2
#: Pieces of a block, on average.
BLOCK = 16_384
#: Packings of an island, children of each of its rounds, and rounds between which the best migrate.
ISLANDS, ROUNDS, POPULATION, GENERATIONS = 4, 3, 4, 32
#: How far the order of pieces strays from decreasing; the most of a donor's full bins that are injected; the most
#: of the other parent's full bins that are dissolved.
STRAY, INJECTED, DISSOLVED = 0.3, 0.5, 0.6

def _piece_batches(capacity: int, vocabulary: str, end: int, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer(vocabulary, ranked)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode_ids(text or "", vocabulary), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                marks = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces; only the first may be shorter than ``capacity``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_piece_batches(capacity, vocabulary, end, by_rank(vocabulary)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> np.ndarray:
    """The bin of each length, one after another: the fullest that has room, or a new one. ``room`` keeps bins by what is left in them."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for length in lengths:
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            at, left = bins, capacity
            bins += 1
        out.append(at)
        left -= length
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(at)
    return np.array(out, np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill, with fewer bins always better. ``bins``: the bin of each length, numbered without gaps."""
    fill = np.bincount(bins, lengths) / capacity
    return -len(fill) + float((fill**2).mean()) if len(fill) else 0.0


def _strayed(lengths: np.ndarray, stray: float, rng: np.random.Generator) -> np.ndarray:
    """Positions of about decreasing length."""
    return np.argsort(-lengths * rng.uniform(1 - stray, 1, len(lengths)), kind="stable")


def crossover(lengths: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two packings of the same ``lengths``, in ascending order.

    Some full bins of ``donor`` are injected whole. Bins of ``into`` that hold one of their pieces are dissolved, as are
    those that aren't full and a share of the full ones; what they held is put back by best fit. Pieces of equal length
    are interchangeable, so the injected ones are taken from the emptiest bins of ``into`` that have their length.
    """
    given, own = np.bincount(donor, lengths), np.bincount(into, lengths)
    full = np.flatnonzero(given >= capacity)
    injected = np.zeros(len(given), bool)
    injected[rng.permutation(full)[: math.ceil(len(full) * INJECTED * rng.random())]] = True
    donor = donor[np.lexsort((~injected[donor], lengths))]
    into = into[np.lexsort((into, own[into], lengths))]
    taken = injected[donor]
    gone = (own < capacity) | (rng.random(len(own)) < DISSOLVED * rng.random())
    gone[into[taken]] = True
    stays = ~gone[into]
    child = np.where(taken, donor, len(given) + into)
    left = np.flatnonzero(~(taken | stays))
    left = left[_strayed(lengths[left], STRAY * rng.random(), rng)]
    child[left] = len(given) + len(own) + best_fit(lengths[left].tolist(), capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve_all(lengths: np.ndarray, people: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The packings of one island after a round, best first. ``people``: packings to start from; others start at random.

    The best of two drawn at random is crossed with any other; a child that is better than the worst, and unlike all,
    takes its place.
    """
    rng = np.random.default_rng(seed)
    people = list(people)
    while len(people) < POPULATION:
        order = _strayed(lengths, STRAY, rng)
        bins = np.empty(len(lengths), np.int64)
        bins[order] = best_fit(lengths[order].tolist(), capacity)
        people.append(bins)
    ranked = sorted(((fitness(lengths, x, capacity), k, x) for k, x in enumerate(people)), key=lambda x: (-x[0], x[1]))[:POPULATION]
    for k in range(generations):
        a, b = min(rng.integers(0, POPULATION, 2)), rng.integers(0, POPULATION)
        child = crossover(lengths, ranked[a][2], ranked[b][2], capacity, rng)
        score = fitness(lengths, child, capacity)
        if score > ranked[-1][0] and score not in [x[0] for x in ranked]:
            ranked = sorted([*ranked[:-1], (score, len(people) + k, child)], key=lambda x: (-x[0], x[1]))
    return [x for _, _, x in ranked]


def evolve(counts: np.ndarray, elite: list[list[tuple[int, ...]]], capacity: int, seed: int, generations: int = GENERATIONS) -> list[tuple[int, ...]]:
    """The best packing of an island as bins of lengths. counts: how many pieces have each length. elite: packings to start from."""
    lengths = np.repeat(np.arange(len(counts)), counts)
    best = evolve_all(lengths, [_labels(_stored(b)) for b in elite], capacity, seed, generations)[0]
    return _bins(_plan(lengths, best))


def _stored(bins: list[tuple[int, ...]]) -> bytes:
    """A packing as lengths, with 0 after each bin."""
    return np.array([x for b in bins for x in (*b, 0)], "<i4").tobytes()


def _bins(stored: bytes) -> list[tuple[int, ...]]:
    flat = np.frombuffer(stored, "<i4")
    return [tuple(x[:-1].tolist()) for x in np.split(flat, np.flatnonzero(flat == 0) + 1)[:-1]]


def _plan(lengths: np.ndarray, bins: np.ndarray) -> bytes:
    """Stored form of a packing that names the bin of each length."""
    order = np.argsort(bins, kind="stable")
    ends = np.flatnonzero(np.append(bins[order][1:] != bins[order][:-1], True)) + 1 if len(order) else []
    return np.insert(lengths[order], ends, 0).astype("<i4").tobytes()


def _labels(stored: bytes) -> np.ndarray:
    """The bin of each length in ascending order, of a stored packing."""
    flat = np.frombuffer(stored, "<i4")
    held = flat > 0
    return (np.cumsum(~held)[held])[np.argsort(flat[held], kind="stable")]


ISLAND = "block long, island int, lengths array<long>, counts array<long>, plans array<binary>, score double"


def _evolve_batches(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.repeat(r["lengths"], r["counts"])
                people = evolve_all(lengths, [_labels(p) for p in r["plans"]], capacity, zlib.crc32(f"{r['block']} {r['island']} {turn}".encode()))
                values = [[r["block"]], [r["island"]], [r["lengths"]], [r["counts"]], [[_plan(lengths, x) for x in people]], [fitness(lengths, people[0], capacity)]]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["block", "island", "lengths", "counts", "plans", "score"])

    return run


def plans(blocks: DataFrame, n: int, capacity: int = CAPACITY) -> DataFrame:
    """The best packing ``block, plan`` of each of the ``n`` blocks of ``blocks(block, lengths, counts)``."""
    islands = blocks.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = None
    for turn in range(ROUNDS):
        if state is None:
            start = islands.withColumn("plans", F.array().cast("array<binary>"))
        else:  # the elite of the island before comes in by a join
            guest = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("plans")[0].alias("guest"))
            start = state.join(guest, ["block", "island"]).withColumn("plans", F.array_append("plans", F.col("guest")))
        # a row is seconds of work; dealt in turn, every task gets as many, and their number is not folded by bytes
        start = start.select("block", "island", "lengths", "counts", "plans").repartition(n * ISLANDS)
        state = materialise(start.mapInArrow(_evolve_batches(capacity, turn), ISLAND))
    return state.groupBy("block").agg(F.max_by(F.col("plans")[0], F.struct("score", -F.col("island"))).alias("plan"))


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(pieces: pa.Table, plan: pa.Table) -> pa.Table:
    flat = np.frombuffer(plan["plan"][0].as_py(), "<i4").astype(np.int64)
    bin_of = np.cumsum(flat == 0) - (flat == 0)
    before = np.cumsum(flat) - flat
    held = flat > 0
    starts = np.concatenate(([0], np.flatnonzero(~held)[:-1] + 1))
    offset = before - before[starts][bin_of]
    slots = np.flatnonzero(held)[np.argsort(flat[held], kind="stable")]
    rows = pieces.take(pa.array(np.argsort(pieces["length"].to_numpy(), kind="stable")))
    block = rows["block"][0].as_py()
    return pa.table({c: rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": (block << 32) + bin_of[slots], "offset": offset[slots]})


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """A place for every piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are the tokenizer's ids and ``end``; a null text counts as empty and is the one token
    ``end``. Documents longer than ``capacity`` are cut from their end, so that only the first piece may be
    shorter. Sequences hold ``capacity`` tokens at most, their pieces without gaps from offset 0. Rows that
    repeat, or have no doc_id, are packed like any other; other columns are ignored; an empty table gives an
    empty table.
    """
    pieces = materialise(pieces_of(docs, capacity, vocabulary, end).withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // BLOCK))
    short = short.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    # at most capacity - 1 entries a block
    tables = short.groupBy("block", "length").agg(F.count("*").alias("n")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("t"))
    chosen = plans(materialise(tables.select("block", F.col("t.length").alias("lengths"), F.col("t.n").alias("counts"))), blocks, capacity)
    placed = short.drop("uid").groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_place, PLACED)
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)
