"""Links between documents whose sets of word shingles are similar, for the near-dedup stage.

A 64-bit SimHash within 3 bits only shows texts that are nearly equal: at a Jaccard similarity of 0.8 over five-word
shingles, fingerprints differ in 6 to 17 bits, and at such a distance no vantage point prunes anything. So the stage
finds links by similarity: bands of min-hash values find candidates. First each row is held against one leader of each
of its bands, and links join rows to classes. Then, in bands that still hold several classes, all pairs of rows of
different classes are held against each other, in cells of bounded size. Sizes drop candidates first, bottom-k sketches then. A sketch holds the smallest hashes of
a text's distinct shingles; beyond ``SKETCH`` shingles its standard error is below 0.015. Pairs within ``MARGIN`` of the
limit, five standard errors, are decided by the whole sets of 64-bit hashes of just their texts; where both sketches
hold all hashes, four or six parts of the union from the limit are enough.

A pair of similarity 0.8 shares a band with probability 0.9994, one of 0.33 with 0.006. ``similar_groups(exact=True)``
adds the exact join of rare shingles (``open_pairs``), which finds what bands don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .simhash import BitCounts, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
SKETCH = 768
#: Sketches decide pairs whose estimate is so far from the limit at least.
MARGIN = 0.07
#: Two sketches that hold all hashes of their texts err only where hashes of 32 bits fall together, each by less than
#: two parts of the union. Among up to FEW hashes three do so once in 10^15 pairs, among twice SKETCH four do.
FEW = 400
#: Bands of min-hash slots: a pair of similarity 0.8 shares a band with probability 0.9994.
BANDS, ROWS = 40, 8
SLOTS = 512
#: Sets from SMALL hashes on have one hash function cut into slots, those below SMALL / SIMILARITY a function for each
#: slot; sizes between have both, so that two sets of the limit's similarity always have one kind in common.
SMALL = 128
#: Rows of a band beyond which it is dealt to cells, in blocks of so many rows: each pair of blocks is a cell. It bounds memory, not pairs.
HOT = 2_048
#: Rows of cells that a task gets, on average.
DEALT = 1_024
#: Texts whose shingles are counted to tell common ones, and counts kept: 1 MB. They set an order, so they bound work, not results.
COUNTED, COMMON = 16_384, 65_536
#: Buckets of nodes that are broadcast, at most: they thin texts out before a shuffle, so they bound work, not results.
BUCKETS = 1 << 20


def _distinct(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    seen = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(text, words):
        seen = np.union1d(seen, hashes)
    return seen


def _seeds(n: int, salt: int) -> np.ndarray:
    """Odd numbers that differ in all their bits."""
    return np.random.default_rng(salt).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


SEEDS = _seeds(BANDS * ROWS, 3)
#: Where an empty slot looks, in this order; then at the next slot that isn't empty.
LENDERS = np.array([np.random.default_rng(100 + t).permutation(SLOTS) for t in range(12)])


def slots_of(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation min-hash of sorted sets, a row each: the least hash of each of SLOTS ranges; an empty range borrows from others, each in an order of its own."""
    least, full = np.zeros((len(sets), SLOTS), np.uint64), np.zeros((len(sets), SLOTS), bool)
    for k, hashes in enumerate(sets):
        of = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least[k, of[first]], full[k, of[first]] = hashes[first], True
    around = np.where(np.tile(full, 2), np.arange(2 * SLOTS), 2 * SLOTS)
    lender = np.minimum.accumulate(around[:, ::-1], 1)[:, ::-1][:, :SLOTS] % SLOTS
    for order in LENDERS[::-1]:
        lender = np.where(full[:, order], order, lender)
    lender = np.where(full, np.arange(SLOTS), lender)
    return np.take_along_axis(least, lender, 1)


def slots_of_small(hashes: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under a function for each slot."""
    with np.errstate(over="ignore"):
        mixed = (hashes[:, None] ^ SEEDS[None, :]) * SEEDS[None, ::-1]
        return (mixed ^ (mixed >> np.uint64(31))).min(0)


def slots(hashes: np.ndarray) -> np.ndarray:
    return slots_of([hashes])[0]


def bands(least: np.ndarray, kind: int = 0) -> np.ndarray:
    """A key for each band of slots, of one row or of many; kinds of slots have keys of their own."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(BANDS * kind), (*least.shape[:-1], BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = (keys ^ least[..., r * BANDS : (r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
            keys = keys ^ (keys >> np.uint64(29))
    return np.ascontiguousarray(keys).view(np.int64)


def compare(a: bytes, b: bytes) -> tuple[float, float]:
    """Jaccard similarity of two sketches, of the smallest hashes of both together the share that both have; and how far it may be off."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.append(True, ~twice)]
    whole = len(x) < SKETCH and len(y) < SKETCH
    most = len(union) if whole else min(SKETCH, len(union))
    if not most:
        return 1.0, 0.0
    shared = both[1:][twice]
    return float(np.searchsorted(shared, union[most - 1], "right")) / most, min(MARGIN, (4 if most <= FEW else 6) / most) if whole else MARGIN


def similarity(a: bytes, b: bytes) -> float:
    return compare(a, b)[0]


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, prints, kept, sets = batch.slice(at, 256), [], [], []
                for text in part["text"]:
                    bits, found = BitCounts(), np.zeros(0, np.uint64)
                    for hashes in shingle_hashes(text.as_py(), words):
                        bits.add(hashes)
                        found = np.union1d(found, hashes)
                    prints.append(bits.fingerprint())
                    kept.append(np.unique((found >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes())
                    sets.append(found)
                sizes = np.array([len(x) for x in sets])
                small, large = np.flatnonzero((sizes > 0) & (sizes < SMALL / SIMILARITY)), np.flatnonzero(sizes >= SMALL)
                keys = [[] for _ in sets]
                if len(large):
                    for i, row in zip(large, bands(slots_of([sets[i] for i in large])), strict=True):
                        keys[i].append(row)
                if len(small):
                    for i, row in zip(small, bands(np.array([slots_of_small(sets[i]) for i in small]), 1), strict=True):
                        keys[i].append(row)
                for i in np.flatnonzero(sizes):  # the last key is that of equal sets: they always meet
                    keys[i].append(np.array([xxhash.xxh64_intdigest(sets[i].tobytes(), 42)], np.uint64).view(np.int64))
                held = [np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys]
                marks = np.concatenate(([0], np.cumsum([len(k) for k in held]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(marks), pa.array(np.concatenate([*held, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(kept, pa.binary()), pa.array(sizes, pa.int32()), lists], SKETCHED_NAMES)

    return run


SKETCHED = "node long, print long, sketch binary, size int, bands array<long>"
SKETCHED_NAMES = [c.split(" ")[0] for c in SKETCHED.split(", ")]


def sketches(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, print, sketch, size, bands`` of ``texts(node, text)``, stored, in one pass: the SimHash, the bottom-k sketch, the number of distinct shingles, the keys of the bands."""
    return materialise(texts.mapInArrow(_sketch_batches(words), SKETCHED))


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [_distinct(t, words).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _judge_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, off = np.array([compare(a.as_py(), b.as_py()) for a, b in zip(batch["a"], batch["b"], strict=True)], float).reshape(-1, 2).T
            out = pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(near >= least + off)], ["u", "v", "sure"])
            yield out.filter(pa.array(near > least - off))

    return run


def _exact_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared / (len(x) + len(y) - shared) >= least)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _thinned(rows: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """``node, what`` of ``nodes(node)`` and of some others. Few are asked for, so most are dropped where they are read, by their bucket."""
    bucket = F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).alias("bucket")
    return rows.select("node", what, bucket).join(F.broadcast(nodes.select(bucket).distinct()), "bucket", "left_semi").select("node", what)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of ``nodes(node)``."""
    return _thinned(texts, nodes, "text").join(nodes, "node", "left_semi")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select(F.col("u").alias("node")).distinct().union(pairs.select("v").distinct()).distinct())


def _with_both(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    a = of.select(F.col("node").alias("u"), F.col(what).alias("a"))
    b = of.select(F.col("node").alias("v"), F.col(what).alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b")


def _decided(judged: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``u, v`` of ``judged(u, v, sure)`` that are sure, or that the whole sets say."""
    close = judged.where("not sure").select("u", "v").distinct()
    sets = materialise(_texts_of(texts, _nodes_of(close)).mapInArrow(_set_batches(words), "node long, hashes binary"))
    exact = _with_both(close, sets, "hashes").mapInArrow(_exact_batches(least), "u long, v long")
    return judged.where("sure").select("u", "v").unionByName(exact)


def alike(pairs: DataFrame, sketched: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` of ``least`` similarity. Only the sketches of their nodes are shuffled."""
    pairs = materialise(pairs)
    held = materialise(sketched.select("node", "sketch").join(_nodes_of(pairs), "node", "left_semi"))
    judged = materialise(_with_both(pairs, held, "sketch").mapInArrow(_judge_batches(least), "u long, v long, sure boolean"))
    return _decided(judged, texts, words, least)


def _shingle_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(text.as_py(), words).view(np.int64))], ["token"])

    return run


def common_shingles(texts: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingle hashes of about COUNTED of ``n`` texts, sorted, and their counts."""
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // COUNTED))) == 0).select("text")
    counts = some.mapInArrow(_shingle_batches(words), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "token").limit(COMMON).toPandas() if n else None
    if rows is None or not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest hashes of a set, so many that sets of ``least`` similarity have one of them in common."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - math.ceil(least * len(hashes) - 1e-6) + 1]]


def _prefix_batches(words: int, common: np.ndarray, counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, of, sizes, after, tokens = batch.slice(at, 256), [], [], [], []
                for node, text in zip(part["node"].to_pylist(), part["text"], strict=True):
                    found = _distinct(text.as_py(), words)
                    if len(found):
                        head = prefix(found, common, counts, least)
                        of.append(np.full(len(head), node, np.int64))
                        sizes.append(np.full(len(head), len(found), np.int32))
                        after.append((len(found) - np.arange(len(head))).astype(np.int32))
                        tokens.append(head.view(np.int64))
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (of, sizes, after, tokens)], ["node", "n", "rest", "token"])

    return run


def open_pairs(texts: DataFrame, n: int, classes: DataFrame, words: int, least: float) -> DataFrame:
    """``u, v``: every pair of ``least`` similarity that ``classes(node, component)`` don't join already, and others.

    With shingles in one order for all texts, rare ones first, two similar sets share a shingle of both prefixes; at
    the first they share, the shingles from there on bound what else they share, as their sizes do. Texts
    that links have joined are one class, and only classes that share a shingle are held against each other, so a
    shingle of one large class makes no pairs.
    """
    heads = materialise(texts.mapInArrow(_prefix_batches(words, *common_shingles(texts, n, words), least), "node long, n int, rest int, token long"))
    met = heads.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("token")
    held = heads.join(met, "token").join(classes, "node", "left").select("token", "node", "n", "rest", F.coalesce("component", "node").alias("class"))
    held = materialise(held)
    group = held.groupBy("token", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    mixed = group.groupBy("token").agg(F.min("class").alias("c"), F.max("class").alias("d")).where("c < d").select("token")
    group = materialise(group.join(mixed, "token"))
    both = group.toDF("token", "class", "low", "high", "rest").join(group.toDF("token", "class2", "low2", "high2", "rest2"), "token").where("class < class2")
    both = both.where(f"high >= {least} * low2 - 1e-6 and high2 >= {least} * low - 1e-6")
    both = both.where(f"least(rest, rest2) >= {least / (1 + least)} * (low + low2) - 1e-6").select("token", "class", "class2")
    a = held.select("token", "class", F.col("node").alias("u"), F.col("n").alias("n1"), F.col("rest").alias("rest1"))
    b = held.select("token", F.col("class").alias("class2"), F.col("node").alias("v"), F.col("n").alias("n2"), F.col("rest").alias("rest2"))
    pairs = both.join(a, ["token", "class"]).join(b, ["token", "class2"])
    pairs = pairs.where(f"n1 >= {least} * n2 - 1e-6 and n2 >= {least} * n1 - 1e-6 and least(rest1, rest2) >= {least / (1 + least)} * (n1 + n2) - 1e-6")
    return pairs.select("u", "v").distinct()


def _sized(least: float, n: str = "n", m: str = "m") -> str:
    """Whether two sizes allow the similarity."""
    return f"least({n}, {m}) >= {least} * greatest({n}, {m}) - 1e-6"


def _cell_pairs(least: float):
    def run(group: pa.Table) -> pa.Table:
        """Pairs of the cell's rows of different classes that sketches don't put below the limit, one sure pair for two classes."""
        node, n, block = (group[c].to_numpy() for c in ("node", "n", "block"))
        names, of = np.unique(group["class"].to_numpy(), return_inverse=True)
        raw = group["sketch"].to_pylist()
        held = [np.frombuffer(x, "<u4") for x in raw]
        sizes = np.array([len(x) for x in held])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        values, ids = np.unique(np.concatenate(held), return_inverse=True)
        mark, crossed = np.zeros(len(values), np.int32), block.min() != block.max()
        widest = np.bincount(of).argmax()
        asks = of != widest
        sure, close = {}, []
        for i in np.flatnonzero(asks):
            fits = (of != of[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-6)
            fits[: i + 1] &= ~asks[: i + 1]  # of two rows that ask, the first does
            if crossed:
                fits &= block != block[i]
            if not fits.any():
                continue
            own = ids[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            union = sizes[i] + sizes - shared
            near, off = shared / union, np.minimum(MARGIN, np.where(union <= FEW, 4, 6) / union)
            part = (sizes >= SKETCH) | (sizes[i] >= SKETCH)
            for j in np.flatnonzero(fits & part & (shared > (least - MARGIN) * SKETCH - 1e-6)):
                near[j], off[j] = compare(raw[i], raw[j])
                part[j] = False
            for j in np.flatnonzero(fits & ~part & (near > least - off)):
                two = (min(of[i], of[j]), max(of[i], of[j]))
                if near[j] >= least + off[j]:
                    sure.setdefault(two, (i, j))
                else:
                    close.append((two, i, j))
        pairs = [(i, j, True) for i, j in sure.values()] + [(i, j, False) for two, i, j in close if two not in sure]
        a, b = (node[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b), "sure": np.array([p[2] for p in pairs], bool)})

    return run


def open_bands(keyed: DataFrame, sketched: DataFrame, texts: DataFrame, classes: DataFrame, words: int, least: float) -> DataFrame:
    """``u, v``: links of ``least`` similarity between all rows of different ``classes(node, component)`` that share a band of ``keyed(key, node, n)``.

    One link for two classes is enough. A band of more than HOT rows is dealt to cells, one for each pair of its blocks.
    """
    held = materialise(keyed.join(classes, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("class")))
    mixed = held.groupBy("key").agg(F.min("class").alias("c"), F.max("class").alias("d"), F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("blocks")).where("c < d").select("key", "blocks")
    rows = materialise(held.join(mixed, "key"))
    wanted = materialise(rows.select("node").distinct())
    full = rows.join(_thinned(sketched, wanted, "sketch"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = full.withColumn("cell", F.explode(F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) as i, greatest(k, block) as j))")))
    cells = cells.select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "node", "n", "class", "block", "sketch")
    n = rows.agg(F.sum("blocks")).first()[0] or 0
    cells = cells.repartition(max(1, min(2_000, n // DEALT + 2 * keyed.sparkSession.sparkContext.defaultParallelism)), "key", "i", "j")
    return _decided(materialise(cells.groupBy("key", "i", "j").applyInArrow(_cell_pairs(least), "u long, v long, sure boolean")), texts, words, least)


def similar_groups(texts: DataFrame, words: int = WORDS, least: float = SIMILARITY, also: DataFrame | None = None, sketched: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """``node, component`` of the nodes of ``texts(node, text)``, node a long, that links of ``least`` similarity join; others have no row.

    ``also``: further candidates ``u, v``, held to the same similarity. ``sketched``: what ``sketches`` gives. Texts without
    words have no links. First each row is compared with the leader of each of its bands, the row that a hash of band and
    node puts first; a band's rows are counted before they are joined with its leader, so a band that very many rows share
    splits like any other join. Then all rows of different classes that share a band meet (``open_bands``). With ``exact``,
    pairs that share no band are found by ``open_pairs``. Later links join classes, which are few rows, not nodes anew. Nodes
    that repeat are one node of all their texts' bands.
    """
    sketched = sketches(texts, words) if sketched is None else sketched
    keyed = sketched.select("node", F.col("size").alias("n"), F.explode("bands").alias("key"))
    order = F.xxhash64("node", "key")
    leaders = keyed.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.struct(order, "node")).alias("r"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", F.col("r.node").alias("v"), F.col("r.n").alias("m"))
    shared = materialise(keyed.join(leaders, "key"))
    pairs = shared.where("node <> v").where(_sized(least)).select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v"))
    met = materialise((pairs.unionByName(also.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))) if also is not None else pairs).distinct())
    classes = materialise(components(alike(met, sketched, texts, words, least)))
    classes = materialise(_joined(classes, open_bands(shared.select("key", "node", "n"), sketched, texts, classes, words, least)))
    return _joined(classes, alike(open_pairs(texts, sketched.count(), classes, words, least), sketched, texts, words, least)) if exact else classes


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with those joined that ``links(u, v)`` join."""
    more = materialise(links)
    a, b = classes.toDF("u", "a"), classes.toDF("v", "b")
    joining = more.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    of = components(joining)
    late = of.join(classes.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    kept = classes.join(of.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return kept.unionByName(late)
