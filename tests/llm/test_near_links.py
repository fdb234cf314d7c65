"""Links of the near-dedup stage: fingerprints only propose, whole shingle sets decide."""

from __future__ import annotations

import numpy as np
from sheafline.llm import simhash, sketch


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())


def test_repeated_line_is_no_link(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"line{i}" for i in range(9))
    own = [[f"o{k}x{i}" for i in rng.permutation(40)] for k in range(8)]
    texts = [" ".join([line] * 40 + words) for words in own]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert all(bin(prints[0] ^ p).count("1") <= simhash.DISTANCE for p in prints)
    # the last two are near copies of each other, but not of the smallest doc_id, the star's centre
    texts.append(" ".join([line] * 40 + [*own[7][:39], "edit"]))
    assert kept(spark, texts) == list(range(8))


def test_long_texts_are_decided_by_whole_sets(spark):
    rng, texts, want = np.random.default_rng(6), [], []
    for k in range(60):
        words = [f"d{k}x{i}" for i in range(4004)]
        # 4000 shingles each, a run of new words at the end: 0.7994 stays, 0.8002 goes
        edits = 446 if k % 2 else 444
        texts += [" ".join(words), " ".join([*words[: 4004 - edits], *(f"e{k}x{i}" for i in rng.permutation(edits))])]
        want += [2 * k, 2 * k + 1] if k % 2 else [2 * k]
    assert kept(spark, texts) == want


def test_pairs_that_no_leader_has(spark):
    rng, texts = np.random.default_rng(9), []
    for k in range(310):
        # ten texts with two edits of one template are similar to each other (0.815), the others, with four, to none
        words = [f"t{i}" for i in range(200)]
        for e in range(2 if k % 31 == 7 else 4):
            words[20 + 40 * e + int(rng.integers(0, 30))] = f"e{k}x{e}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (t.split() for t in texts)]
    of = list(range(310))
    for a in range(310):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = of[a], of[b]
                of = [min(x, y) if z in (x, y) else z for z in of]
    assert len(set(of)) <= 301
    assert kept(spark, texts) == sorted(set(of))


def test_whole_sketches_decide_but_for_the_limit():
    rng, left = np.random.default_rng(0), 0
    for _ in range(4000):
        n = int(rng.integers(1, 760))
        x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        y = x.copy()
        k = int(rng.integers(0, n // 4 + 1))
        y[:k] = rng.integers(0, 2**63, k).astype(np.uint64)
        shared = len(np.intersect1d(x, y))
        true = shared / (2 * n - shared)
        near, off = sketch.compare(*(np.unique((z >> np.uint64(32)).astype("<u4"))[: sketch.SKETCH].tobytes() for z in (x, y)))
        assert abs(near - true) < off
        assert off <= sketch.MARGIN
        left += abs(near - 0.8) < off
    assert left < 600


def keys_of(spark, sets):
    """The keys of the bands of texts whose distinct words are their one-word shingles."""
    texts = spark.createDataFrame([(k, " ".join(str(x) for x in s)) for k, s in enumerate(sets)], "node long, text string")
    return {r.node: set(r.bands) for r in sketch.sketches(texts, 1).collect()}


def test_similar_sets_share_a_band(spark):
    rng = np.random.default_rng(11)
    for size in (9, 30, 80, 105, 118, 127, 128, 150, 161, 300, 600, 2000):
        sets = []
        for k in range(150):
            joint, own = round(size * 0.8) + 1, size - round(size * 0.8) - 1  # just above the limit
            base = rng.integers(0, 2**40, joint + own)
            cut = int(rng.integers(0, own + 1))
            sets += [base[: joint + cut], np.concatenate((base[:joint], base[joint + cut :]))]
        keys = keys_of(spark, sets)
        met = sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(150))
        assert met >= 0.97 * 150, (size, met)


def test_texts_of_common_sentences_make_few_candidates(spark):
    rng = np.random.default_rng(0)
    sentences = [" ".join(f"w{s}x{i}" for i in range(10)) for s in range(60)]
    counts = []
    for n in (300, 1200):
        rows = [(k, " ".join(sentences[i] for i in rng.permutation(60)[:30])) for k in range(n)]
        keys = keys_of_words(spark, rows)
        counts.append(len({tuple(sorted(p)) for held in keys.values() for p in ((a, b) for a in held for b in held if a < b)}))
    assert counts[1] < 400


def keys_of_words(spark, rows):
    held = {}
    for r in sketch.sketches(spark.createDataFrame(rows, "node long, text string"), 5).collect():
        for key in r.bands:
            held.setdefault(key, []).append(r.node)
    return held


def test_hot_bands_lose_no_copies(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HOT", 2)
    rng, texts, want = np.random.default_rng(12), [], []
    page = [f"p{i}" for i in range(60)]
    for k in range(120):  # a passage that all share, and copies of every third text
        words = page + [f"d{k}x{i}" for i in rng.permutation(25)]
        want.append(len(texts))
        texts.append(" ".join(words))
        if k % 3 == 0:
            texts.append(" ".join([*words[:-2], "one", "two"]))
    assert kept(spark, texts) == want


def test_links_to_any_row_of_a_class(spark):
    rng, texts = np.random.default_rng(21), []
    for a in range(36):
        for b in range(a):  # one class: each pair of places edited, in the same way by all
            words = [f"t{i}" for i in range(460)]
            words[10 * a + 5], words[10 * b + 5] = f"e{a}", f"e{b}"
            texts.append(words)
    for k in range(12):  # nine edits more of one of them: similar to it (0.82), to no other (0.785)
        words = list(texts[int(rng.integers(50 * k, 50 * k + 50))])
        for place in range(36, 45):
            words[10 * place + 5] = f"n{k}x{place}"
        texts.append(words)
    assert kept(spark, [" ".join(w) for w in texts]) == [0]
