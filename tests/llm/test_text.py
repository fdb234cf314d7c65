"""SimHash, packing and decontamination against brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from sheafline.llm import components, decontam, packing, simhash, tokens

SCHEMA = "doc_id long, text string, print long, block long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)


def brute_print(text, k=3):
    words = [w for w in "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=3):
    """prints: by doc_id; the smallest id that links reach."""
    of = {i: i for i in prints}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= distance and (x := find(a)) != (y := find(b)):
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for t in ["", None, "One", "one TWO", "a b c d e", "É à\tx\n y z", "w " * 3000, " - ".join(map(str, range(500)))]:
        assert simhash.fingerprint(t) == brute_print(t)


def test_near_duplicates(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(base)] + [(1000 + k, t.replace("w7 ", "v ", 1)) for k, t in enumerate(base)] + [(2000, None), (2001, ""), (2002, "  "), (2003, base[0]), (2003, base[0])]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    groups = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    assert len(set(groups.values())) < 300
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_trees_find_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    near = base[:1500].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([base, near]))
    want = Counter()
    root = simhash.Forest(len(points))
    for i in range(0, len(points), 500):
        a, b = np.nonzero(simhash.apart(points[i : i + 500][:, None], points[None, :]) <= 3)
        root.add(a + i, b)
    assert (simhash.link(points, np.ones(len(points), bool)) == root.root).all()
    nodes = simhash.plant(points, len(points), 300)
    assert sum(len(n) == 1 for n in nodes) > 3
    homes, shared = Counter(), defaultdict(set)
    for shard, own, home in simhash.route(nodes, points):
        homes.update(own[home].tolist())
        for i in own.tolist():
            shared[i].add(shard)
        want[shard] += len(own)
    assert set(homes.values()) == {1} and len(homes) == len(points)
    home_of = {i: s for s, own, home in simhash.route(nodes, points) for i in own[home].tolist()}
    for i in range(0, len(points), 500):
        for a, b in zip(*np.nonzero(simhash.apart(points[i : i + 500][:, None], points[None, :]) <= 3), strict=True):
            assert home_of[int(b)] in shared[int(a) + i]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 150)
    rng = np.random.default_rng(1)
    rows = [(k, "word " * int(n)) for k, n in enumerate(rng.integers(0, 700, 400))] + [(500, None), (501, ""), (502, "a b " * 3000), (None, "x"), (7, "y"), (7, "y")]
    got = packing.pack(docs(spark, rows)).collect()
    ids = {t: np.append(tokens.encode_ids(t or ""), np.uint32(2)).astype("<u4") for _, t in rows}
    want = []
    for i, t in rows:
        n = len(ids[t])
        marks = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[t][a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(bins) <= least * 1.03 + 3
    assert packing.pack(docs(spark, [])).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 500)
    counts = np.bincount(lengths, minlength=1024)
    best = packing.evolve(counts, [], 1024, 1)
    assert Counter(x for b in best for x in b) == Counter(lengths.tolist()) and max(map(sum, best)) <= 1024
    assert packing._bins(packing._stored(best)) == best


def brute_overlap(doc, item, window=13, share=0.8):
    import math

    w = min(window, len(item))
    if not w:
        return False
    for d in range(-len(item) + w, len(doc) - w + 1):
        for j in range(max(0, -d), min(len(item), len(doc) - d) - w + 1):
            if sum(doc[d + j + k] == item[j + k] for k in range(w)) >= math.ceil(share * w - 1e-9):
                return True
    return False


def test_decontamination(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate([20, 40, 15, 30, 9, 4, 1, 13])]
    items += [(20, items[0][1]), (21, None), (22, " .. "), (None, "w1 w2 w3")]
    rows = []
    for k, (_, t) in enumerate(items[:8]):
        host = list(rng.choice(words, 200))
        part = t.split()
        rows.append((k, " ".join(host[:90] + part + host[90:])))
        if len(part) >= 15:
            changed = [x if j % 7 else "other" for j, x in enumerate(part)]
            rows.append((100 + k, ", ".join(host[:30] + [x.upper() for x in changed] + host[30:]) + "!"))
        rows.append((200 + k, " ".join(host[:90] + part[: len(part) // 3] + host[90:])))
        rows.append((300 + k, " ".join(host)))
    rows += [(900, None), (901, ""), (None, items[1][1])]
    norm = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    want = {(i, m) for i, t in rows for m, u in items if m is not None and m != 20 and brute_overlap(norm(t), norm(u))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.BLOCK_WORDS, 40):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", most)
        got = decontam.overlaps(docs(spark, rows), bench)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        clean = decontam.drop_contaminated(docs(spark, rows), bench)
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {w for w, _ in want})
        assert clean.columns == ["doc_id", "text", "print", "block"]
    assert {(k, k) for k in range(8)} <= want and (100, 0) in want
    assert decontam.overlaps(docs(spark, []), bench).count() == 0 and decontam.overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def best_fit_decreasing(lengths, capacity=1024):
    return len(set(packing.best_fit(sorted(lengths, reverse=True), capacity).tolist()))


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly: best fit in decreasing order wastes bins, and no packing of the start is as good as the last."""
    rng = np.random.default_rng(3)
    triples = []
    for _ in range(60):
        a = int(rng.integers(390, 510))
        b = int(rng.integers((1024 - a) // 3, (1024 - a) // 2))
        triples += [a, b, 1024 - a - b]
    counts = np.bincount(triples, minlength=1024)
    lengths = np.sort(triples)
    start = packing.evolve_all(lengths, [], 1024, 5, 0)
    best = packing.evolve(counts, [], 1024, 5, 1500)
    assert Counter(x for b in best for x in b) == Counter(triples) and max(map(sum, best)) <= 1024
    assert 60 <= len(best) < best_fit_decreasing(triples) and len(best) < min(int(x.max()) + 1 for x in start)


def test_evolution_is_not_above_best_fit(spark):

    rng = np.random.default_rng(9)
    lengths = np.clip(rng.gamma(2, 220, 3000).astype(int), 3, 1023)
    kinds, counts = np.unique(lengths, return_counts=True)
    block = spark.createDataFrame([(0, kinds.tolist(), counts.tolist())], "block long, lengths array<long>, counts array<long>")
    plan = packing.plans(block, 1).collect()[0].plan
    bins = packing._bins(bytes(plan))
    assert Counter(x for b in bins for x in b) == Counter(lengths.tolist()) and max(map(sum, bins)) <= 1024
    assert len(bins) <= best_fit_decreasing(lengths.tolist())
    assert (np.bincount(packing._labels(bytes(plan)), np.sort(lengths)) <= 1024).all()


@pytest.mark.parametrize("spread", [64, 12])
def test_choices_of_parts_meet(spread):
    """Whatever bits differ, one mask has none of them; for random points, and for a crowd around one."""
    import itertools

    rng = np.random.default_rng(4)
    for n in (1_000, 10**6, 10**9):
        ones = np.where(np.arange(64) < spread, n * rng.uniform(0.2, 0.8, 64), 0)
        masks = simhash.choices(ones, n)
        for bits in itertools.combinations(range(64), 3):
            assert not np.bitwise_and(masks, np.uint64(sum(1 << b for b in bits))).all()


def test_shards_are_dealt_out(spark, monkeypatch):
    """A crowd of near copies and random points: cells give the groups of comparing all pairs."""
    rng = np.random.default_rng(12)
    crowd = np.full(1500, rng.integers(0, 2**62), np.uint64)
    for b in range(14):
        crowd ^= (rng.random(1500) < 0.3).astype(np.uint64) << np.uint64(4 * b)
    far = rng.integers(0, 2**63, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([crowd, far, far[:500] ^ np.uint64(5)]))
    want = simhash.Forest(len(points))
    for i in range(0, len(points), 500):
        a, b = np.nonzero(simhash.apart(points[i : i + 500][:, None], points[None, :]) <= 3)
        want.add(a + i, b)
    for cell, leaf in ((100, 256), (100, 4), (8192, 256)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "SHARD", 300)
        prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "print long")
        got = simhash.Forest(len(points))
        at = {int(x): k for k, x in enumerate(points.view(np.int64))}
        pairs = [(at[r.u], at[r.v]) for r in simhash.links(prints, len(points)).collect()]
        got.add(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert (got.root == want.root).all()
