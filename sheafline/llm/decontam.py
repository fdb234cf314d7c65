"""Benchmark decontamination by spaced-seed hashing.

Texts become words (lower-cased runs of letters and digits), words become 64-bit hashes. A fixed mask looks at
some positions of a window and ignores the others, so a hash of what it sees is the same after substitutions at
ignored positions. The seeds of the benchmark and of the documents are joined by hash; around each hit the two
texts are laid over one another and compared word by word.

What is found is exact. A *window* is ``WINDOW`` words in a row of an item, or the whole item if that is shorter; it
is *good* at a place of a document if ``SIMILARITY`` of its words agree there. An *overlap* is a run of good windows,
each one word after the last, without the differing words at its two ends. The masks are such that every good window
holds a hit of one of them, however its substitutions lie (tests go through all of them, for every length). Items of
very few words are in documents by chance; ``least`` leaves out those of fewer words.

The benchmark's side of the join is sent to the tasks in blocks of a bounded number of words; a benchmark of more
words takes one pass over the documents for each block. The documents are never shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The masks; 1 is looked at, 0 is ignored. Any two substitutions in 13 words leave one of them room.
MASKS = ("1110010111", "110110001011", "101011100011", "1111111", "11110111")
WINDOW = 13
SIMILARITY = 0.8
#: Words of the benchmark that are broadcast at once: 32 MB of hashes, and about as much again for each mask.
BLOCK_WORDS = 2_000_000
#: Bits of the largest table that sorts out most seeds before the join.
TABLE_BITS = 22
#: Hits that are compared at once; bounds the memory where many items share a phrase.
HITS = 200_000


def needed(window: int) -> int:
    """Words of a window that must agree."""
    return math.ceil(SIMILARITY * window - 1e-9)


def masks_of(length: int) -> tuple[str, ...]:
    """The masks for items of ``length`` words.

    A shorter item than ``WINDOW`` is one window, and its masks span it: its places are dealt to groups in turn, and
    each mask ignores as many groups as substitutions are allowed, so every choice of places is ignored by one.
    """
    if length >= WINDOW:
        return MASKS
    allowed = length - needed(length)
    groups = (1, 3, 4)[allowed]
    return tuple("".join("0" if i % groups in ignored else "1" for i in range(length)) for ignored in itertools.combinations(range(groups), allowed))


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """All words of all texts as codes, the word of each code, and where each text's words start (one more for the end).

    Words are lower-cased runs of letters and digits. Null counts as empty.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths, encoded = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    names, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    real = np.array([bool(w) for w in names], bool)[codes] if len(codes) else np.zeros(0, bool)
    if not real.all():  # a blank text splits into one empty word
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
    return codes.astype(np.int64), names, starts.astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start."""
    codes, names, starts = words_of(texts)
    own = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
    return (own[codes] if len(codes) else np.zeros(0, np.uint64)), starts


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash at each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for at in (i for i, x in enumerate(mask) if x == "1"):
            out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _joined(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of whole numbers, both ends included, that overlap or follow one another in a group, as one range each."""
    if not len(low):
        return group, low, high
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    base = np.unique(group, return_inverse=True)[1] * (int(high.max()) + 2)
    reach = np.maximum.accumulate(base + high)
    first = np.flatnonzero(np.append(True, base[1:] + low[1:] > reach[:-1] + 1))
    return group[first], low[first], np.maximum.reduceat(reach, first) - base[first]


class Block:
    """A block of the benchmark: its words and, for each mask, its seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int = 1):
        self.words, self.starts = word_hashes(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        lengths = np.diff(self.starts)
        self.window = np.minimum(lengths, WINDOW)
        self.need = np.array([needed(w) for w in range(WINDOW + 1)])[self.window]
        self.owner = np.repeat(np.arange(len(ids)), lengths)
        self.index = []
        for kind in sorted({min(int(n), WINDOW) for n in lengths if n >= max(1, least)}):
            for mask in masks_of(kind):
                salt = len(self.index) + 1
                found = seeds(self.words, mask, salt)
                at = np.arange(len(found))
                at = at[(self.owner[at] == self.owner[at + len(mask) - 1]) & (self.window[self.owner[at]] == kind)]
                order = np.argsort(found[at], kind="stable")
                bits = min(TABLE_BITS, max(8, len(at).bit_length() + 6))
                table = np.zeros(1 << bits, bool)
                table[found[at] >> np.uint64(64 - bits)] = True
                self.index.append((mask, salt, found[at][order], at[order], table, np.uint64(64 - bits)))

    def hits(self, words: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places in ``words`` and in the block whose seeds agree, HITS or so at once, and the length of the mask."""
        for mask, salt, keys, places, table, shift in self.index:
            found = seeds(words, mask, salt)
            near = np.flatnonzero(table[found >> shift])
            near = near[text_of[near] == text_of[near + len(mask) - 1]]
            low, high = np.searchsorted(keys, found[near], "left"), np.searchsorted(keys, found[near], "right")
            near, low, high = near[high > low], low[high > low], high[high > low]
            total = np.cumsum(high - low)
            at = 0
            while at < len(near):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, "right")))
                # a place that more than HITS places of the block answer is split too
                for k in range(0, int((high - low)[at]) if end == at + 1 else 1, HITS):
                    a = low[at:end] + k
                    n = np.minimum(high[at:end], a + HITS) - a if end == at + 1 else (high - low)[at:end]
                    yield np.repeat(near[at:end], n), places[_spread(a, n)], len(mask)
                at = end

    def good(self, words: np.ndarray, starts: np.ndarray, p: np.ndarray, q: np.ndarray, span: int, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The good windows that hold one of the hits: (diagonal, first start, last start) of runs of them.

        A diagonal is an item and the shift between places in the block and in ``words``, as one number.
        """
        m, t, shift = self.owner[q], text_of[p], p - q
        low = np.maximum(p + span - self.window[m], np.maximum(starts[t], self.starts[m] + shift))
        high = np.minimum(p, np.minimum(starts[t + 1], self.starts[m + 1] + shift) - self.window[m])
        fits = low <= high
        diagonal, low, high = _joined(self.diagonal(m[fits], shift[fits], words), low[fits], high[fits])
        m, shift = self.undiagonal(diagonal, words)
        w, n = self.window[m], high - low + 1
        at = _spread(low, n + w - 1)
        agree = np.append(0, np.cumsum(words[at] == self.words[at - np.repeat(shift, n + w - 1)]))
        begin = np.cumsum(n + w - 1) - (n + w - 1)
        i = _spread(begin, n)
        good = agree[i + np.repeat(w, n)] - agree[i] >= np.repeat(self.need[m], n)
        places, of = _spread(low, n)[good], np.repeat(diagonal, n)[good]
        return _joined(of, places, places)

    def diagonal(self, m: np.ndarray, shift: np.ndarray, words: np.ndarray) -> np.ndarray:
        return m * (len(words) + len(self.words) + 1) + shift + len(self.words)

    def undiagonal(self, diagonal: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = len(words) + len(self.words) + 1
        return diagonal // wide, diagonal % wide - len(self.words)

    def verified(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows of (text, item, first word in the text, first word in the item, words, of which agree), the best overlap of each text and item."""
        text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        runs = [self.good(words, starts, p, q, span, text_of) for p, q, span in self.hits(words, text_of)]
        if not runs:
            return np.zeros((0, 6), np.int64)
        diagonal, low, high = _joined(*(np.concatenate(c) for c in zip(*runs, strict=True)))
        m, shift = self.undiagonal(diagonal, words)
        n = high - low + self.window[m]
        parts, total, i = [], np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 20 * HITS, "right")))
            at = _spread(low[i:j], n[i:j])
            same = words[at] == self.words[at - np.repeat(shift[i:j], n[i:j])]
            begin = np.cumsum(n[i:j]) - n[i:j]
            first, last = np.minimum.reduceat(np.where(same, at, len(words)), begin), np.maximum.reduceat(np.where(same, at, -1), begin)
            t, item = text_of[first], m[i:j]
            parts.append(np.stack([t, item, first - starts[t], first - shift[i:j] - self.starts[item], last - first + 1, np.add.reduceat(same, begin, dtype=np.int64)], 1))
            i = j
        rows = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 4], -rows[:, 5], rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def _portions(texts: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``most`` bytes of text each, so that the words of a batch fit in memory."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def benchmark_blocks(benchmark: DataFrame, least: int = 1) -> Iterator[Block]:
    """The benchmark in blocks of at most about BLOCK_WORDS words. Items of equal text are one, by the smallest item_id."""
    one = benchmark.where("text is not null and item_id is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    total = one.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    blocks = max(1, int(-(-total // BLOCK_WORDS)))
    for k in range(blocks):
        rows = one.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id").collect()
        yield Block([r["item_id"] for r in rows], [r["text"] for r in rows], least)


OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matched long"


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Each pair of a row of ``docs(doc_id, text)`` and an item of ``benchmark(item_id, text)`` that the row holds.

    Returns doc_id, item_id, doc_start, item_start (words before the overlap), n_words, n_matched: the overlap of the
    pair in which most words agree, of those the shortest, then the first. Null and empty texts hold nothing, items
    without words or item_id, or of fewer than ``least`` words, are held by none; items of equal text are one, by the
    smallest item_id. Rows that repeat are reported each; other columns are ignored; empty tables give an empty table.
    """
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in benchmark_blocks(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in _portions(batch["text"]):
                    found = sent.value.verified(*word_hashes(batch["text"].slice(a, b - a)))
                    if len(found):
                        ids = batch["doc_id"].slice(a, b - a).take(pa.array(found[:, 0]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(sent.value.ids[found[:, 1]]), *(pa.array(found[:, k]) for k in range(2, 6))], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched"])

        part = rows.mapInArrow(run, OVERLAPS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark of ``least`` words, with all their columns. Nothing is shuffled.

    Between blocks what is left is stored, so that a worker holds one block at a time.
    """
    first = True
    for block in benchmark_blocks(benchmark, least):
        docs = docs if first else materialise(docs)
        first, sent = False, docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in _portions(batch["text"]):
                    clean = np.ones(b - a, bool)
                    clean[sent.value.verified(*word_hashes(batch["text"].slice(a, b - a)))[:, 0]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
