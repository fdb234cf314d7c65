"""SimHash near-dedup with vantage-point trees.

Each whole text becomes a 64-bit fingerprint. Equal fingerprints are one point. A tree of vantage points, drawn
from a bounded sample, cuts the points into shards: at each node, those within a radius of the vantage point go
one way, the others the other way. By the triangle inequality a point can only have neighbours on the other side
if its distance to the vantage point is within the link distance of the radius; such points also visit that side
as guests.

The tree is cut no finer than guests allow: where a branch gets more than ``GUESTS`` times its own points, it stays a
shard. So a shard can hold many points, as can one with a crowd of near copies that no vantage point parts. Shards are
therefore counted and dealt out to cells: of four parts of a fingerprint, three bits that differ leave one equal (of
five two, of six three), so points that share such a choice of parts meet in a cell, and are linked there, by a tree in
memory where many share it. Each shard has parts of its own, with the bits that vary in it spread evenly over them. A
cell returns a star for each group that it has found, never all pairs; the stars of all cells are joined to components.

Radii are not medians: distances between unrelated fingerprints crowd around 32, where a median cut sends most
points both ways. Each node takes the vantage point and radius whose cut costs least, from the sample's distances.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

#: Fingerprints that differ in so many bits at most are linked.
DISTANCE = 3
#: Points from which vantage points and radii are chosen on the driver: 512 kB.
SAMPLE = 65_536
#: Points that call a shard home, on average.
SHARD = 16_384
#: Times its own points that a branch of the tree may get, with guests.
GUESTS = 3.0
#: Rows of a cell, on average.
CELL = 8_192
#: Points of a leaf of the trees in memory.
LEAF = 256
#: Shingles hashed at once; bounds the memory for a long text.
BLOCK = 65_536


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every ``words``-word shingle, repeats included, in blocks.

    A-Z are lower-cased, words are runs without ASCII white space, joined by one space. A text of fewer words is
    one shingle; a text of none has none. Null counts as empty.
    """
    data = b" ".join((text or "").encode().lower().split())
    if not data:
        return
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(data)]))
    k = min(words, len(starts))
    starts, ends, h = starts[: len(starts) - k + 1], ends[k - 1 :], xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        yield np.array([h(data[a:b], 42) for a, b in zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist(), strict=True)], np.uint64)


class BitCounts:
    """How many hashes set each bit."""

    def __init__(self):
        self.counts, self.n = np.zeros(64, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        self.n += len(hashes)

    def fingerprint(self) -> int:
        """The bits set in over half of the hashes; 0 where there are none."""
        return int(np.packbits(2 * self.counts > self.n, bitorder="little").view(np.uint64)[0]) if self.n else 0


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash: a bit is 1 if it is set in over half of the shingles' hashes; 0 where there are none."""
    bits = BitCounts()
    for hashes in shingle_hashes(text, words):
        bits.add(hashes)
    return bits.fingerprint()


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "print"])

    return run


def apart(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def cut(points: np.ndarray, rng: np.random.Generator, candidates: int = 12, least: float = 1 / 64) -> tuple[np.uint64, int, float] | None:
    """Vantage point and radius of the cheapest cut, with its cost exponent; None if no cut prunes.

    With shares p inside, a that visit inside and b that visit outside, a search over n points costs n to the
    power s, where a p^s + b (1-p)^s = 1.
    """
    chosen = points[rng.integers(0, len(points), candidates)]
    seen = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    best, s = None, np.linspace(0.05, 0.98, 60)
    for v in chosen:
        share = np.cumsum(np.bincount(apart(seen, v), minlength=65)) / len(seen)
        for radius in range(1, 63):
            p = share[radius]
            if least <= p <= 1 - least:
                a, b = share[min(64, radius + DISTANCE)], 1 - (share[radius - DISTANCE] if radius >= DISTANCE else 0)
                good = np.flatnonzero(a * p**s + b * (1 - p) ** s <= 1)
                if len(good) and (best is None or s[good[0]] < best[2]):
                    best = (v, radius, float(s[good[0]]))
    return best


def plant(sample: np.ndarray, n: float, shard: int = SHARD, seed: int = 7) -> list[tuple]:
    """A tree over the sample as a list of nodes: (vantage, radius, inner, outer), or (shard number,).

    ``n``: points that the sample stands for. Nodes with few of the sample stay shards, so the tree is bounded, as do
    those that would be visited by more than GUESTS times their own points.
    """
    rng, nodes, shards = np.random.default_rng(seed), [], 0
    todo = [(sample, n, None, 0, 1.0)]
    while todo:
        own, size, parent, side, visits = todo.pop()
        at, found = len(nodes), None
        if size > shard and len(own) >= 64 and visits < GUESTS:
            found = cut(own, rng)
        if parent is not None:
            nodes[parent][side] = at
        if not found:
            nodes.append([shards])
            shards += 1
            continue
        vantage, radius, _ = found
        d = apart(own, vantage).astype(np.int64)
        inside = d <= radius
        nodes.append([vantage, radius, None, None])
        share, inner, outer = inside.mean(), (d <= radius + DISTANCE).mean(), (d > radius - DISTANCE).mean()
        todo += [(own[inside], size * share, at, 2, visits * inner / share), (own[~inside], size * (1 - share), at, 3, visits * outer / (1 - share))]
    return [tuple(x) for x in nodes]


def route(nodes: list[tuple], points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, whether it is their home) of all points that a shard gets."""
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if len(nodes[at]) == 1:
            yield nodes[at][0], own, home
            continue
        vantage, radius, inner, outer = nodes[at]
        d = apart(points[own], vantage).astype(np.int64)
        within = d <= radius
        for child, side, near in ((inner, within, d <= radius + DISTANCE), (outer, ~within, d > radius - DISTANCE)):
            todo.append((child, own[near], (home & side)[near]))


class Forest:
    """Groups of positions that links have joined; links come in batches, most of which join nothing new."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def link(points: np.ndarray, home: np.ndarray, seed: int = 11) -> np.ndarray:
    """The group of each point: links between any point and those at home, all found, by a tree in memory."""
    rng, forest = np.random.default_rng(seed), Forest(len(points))
    todo = [(np.flatnonzero(home), np.arange(len(points)), 0)]
    while todo:
        held, asking, depth = todo.pop()
        if not len(held) or not len(asking):
            continue
        found = cut(points[held], rng, 4) if len(held) > LEAF and depth < 400 else None
        if found is None or found[2] > 0.95:
            step = max(1, 4_000_000 // len(held)) if len(held) < 65_536 else 64
            for i in range(0, len(asking), step):
                for j in range(0, len(held), 65_536):
                    q, h = asking[i : i + step], held[j : j + 65_536]
                    x, y = np.nonzero(apart(points[q][:, None], points[h][None, :]) <= DISTANCE)
                    forest.add(q[x], h[y])
            continue
        vantage, radius, _ = found
        inside = apart(points[held], vantage) <= radius
        d = apart(points[asking], vantage).astype(np.int64)
        todo += [(held[inside], asking[d <= radius + DISTANCE], depth + 1), (held[~inside], asking[d > radius - DISTANCE], depth + 1)]
    return forest.root


def _route_batches(nodes: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch["print"].to_numpy(zero_copy_only=False).astype(np.int64)
            for shard, own, home in route(nodes, signed.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard), pa.int32()), pa.array(signed[own]), pa.array(home)], ["shard", "print", "home"])

    return run


def choices(ones: np.ndarray, n: int) -> np.ndarray:
    """Masks of which two fingerprints that differ in DISTANCE bits at most have one in common, for ``n`` points with ``ones`` of each bit.

    The bits are dealt to DISTANCE + 1 parts or more, those that vary most first; each mask is the union of all parts
    but DISTANCE. More parts make longer masks, and more of them: the first number is taken with which a mask tells
    CELL points apart, by the entropy of its bits.
    """
    p = np.clip(ones / max(n, 1), 1e-9, 1 - 1e-9)
    entropy = -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    order = np.argsort(-entropy, kind="stable")
    for parts in range(DISTANCE + 1, DISTANCE + 4):
        turn = np.arange(64) % (2 * parts)
        part = np.empty(64, np.int64)
        part[order] = np.minimum(turn, 2 * parts - 1 - turn)  # there and back
        chosen = list(itertools.combinations(range(parts), parts - DISTANCE))
        if n / 2 ** min(entropy[np.isin(part, c)].sum() for c in chosen) * LEAF <= CELL:
            break
    return np.array([sum(1 << b for b in range(64) if part[b] in c) for c in chosen], np.uint64)


def _deal_batches(dealt: dict[int, tuple[np.ndarray, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, signed, home = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "print", "home"))
            for shard in np.unique(shards):
                own = np.flatnonzero(shards == shard)
                masks, cells = dealt[int(shard)]
                for k, mask in enumerate(masks):
                    with np.errstate(over="ignore"):
                        key = ((signed[own].astype(np.int64).view(np.uint64) & mask) ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                        key ^= key >> np.uint64(32)
                    cell = (key % np.uint64(cells)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard), pa.int32()), pa.array(cell), pa.array(key.view(np.int64)), pa.array(signed[own]), pa.array(home[own])], ["shard", "cell", "key", "print", "home"])

    return run


def _link_cell(group: pa.Table) -> pa.Table:
    """Stars of the links between points of equal keys: neighbours in key order where few share a key, trees where many do."""
    key = group["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    key, home = key[order], group["home"].to_numpy().astype(bool)[order]
    signed = group["print"].to_numpy().astype(np.int64)[order]
    points, forest = signed.view(np.uint64), Forest(len(key))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    few = np.repeat(size <= LEAF, size)
    for step in range(1, min(LEAF, int(size.max()))):
        at = np.flatnonzero(few[:-step] & (key[step:] == key[:-step]) & (home[step:] | home[:-step]))
        if not len(at):
            break
        at = at[apart(points[at], points[at + step]) <= DISTANCE]
        forest.add(at, at + step)
    for a, n in zip(first[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        forest.add(np.arange(a, a + n), a + link(points[a : a + n], home[a : a + n]))
    linked = np.flatnonzero(forest.root != np.arange(len(key)))
    return pa.table({"u": signed[linked], "v": signed[forest.root[linked]]})


def links(prints: DataFrame, n: int) -> DataFrame:
    """Stars ``u, v`` whose components are those of all links among the distinct ``prints(print)``; ``n`` of them."""
    sample = prints.orderBy(F.xxhash64("print")).limit(min(SAMPLE, 512 + 32 * (n // SHARD + 1)))
    drawn = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    nodes = plant(drawn, n) if len(drawn) else [(0,)]
    dealt = materialise(prints.mapInArrow(_route_batches(nodes), "shard int, print long, home boolean"))
    # a row for each shard, of which there are no more than a 64th of the sample
    ones = [F.sum(F.shiftrightunsigned("print", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    split = {}
    for row in dealt.groupBy("shard").agg(F.count("*").alias("n"), *ones).collect():
        masks = choices(np.array(row[2:], float), row["n"])
        split[row["shard"]] = (masks, -(-row["n"] * len(masks) // CELL))
    cells = dealt.mapInArrow(_deal_batches(split), "shard int, cell int, key long, print long, home boolean")
    n_cells = sum(x for _, x in split.values())
    cells = cells.repartition(max(1, min(n_cells, max(2_000, n_cells // 64))), "shard", "cell")
    return cells.groupBy("shard", "cell").applyInArrow(_link_cell, "u long, v long")


def grouped(rows: DataFrame) -> DataFrame:
    """``print, component_id`` of each distinct print of ``rows(doc_id, print)``: the smallest doc_id of its component."""
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    stars = materialise(links(prints.select("print"), prints.count()))
    of = components(stars)
    joined = prints.join(of, prints["print"] == of["node"], "left").select("print", "first_id", F.col("component"))
    linked = materialise(joined.where("component is not null"))
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    alone = joined.where("component is null").select("print", F.col("first_id").alias("component_id"))
    return linked.join(lowest, "component").select("print", "component_id").unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at DISTANCE or fewer differing bits; the component_id is the smallest doc_id that links
    reach. Null texts count as empty: fingerprint zero, linked like any other. A null doc_id is never the
    smallest, unless a component has no other. Rows that repeat are rows of their own; other columns are
    ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches(words), "doc_id long, print long")
    rows = materialise(rows)
    named = grouped(rows)
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group of near copies the smallest doc_id.

    Links are those of ``sketch.similar_groups`` at a similarity of 0.8. The tree over fingerprints of ``words``-word
    shingles adds candidates to it, no links: fingerprints count repeats, so one line often repeated brings texts
    together that differ in all else. Texts without words are no copies of one another here. Rows of a null doc_id stay;
    rows that share a doc_id stay or go together.
    """
    from .sketch import similar_groups, sketches

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    sketched = sketches(texts, words)
    rows = sketched.where("print != 0").select(F.col("node").alias("doc_id"), "print")
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    same = rows.join(prints, "print").select(F.col("doc_id").alias("u"), F.col("first_id").alias("v")).where("u != v")
    stars = links(prints.select("print"), prints.count())
    first = prints.select("print", "first_id")
    near = stars.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = similar_groups(texts, words, also=same.unionByName(near), sketched=sketched)
    losers = groups.where("node != component").select("node")
    return docs.join(losers, docs["doc_id"] == losers["node"], "left_anti")
