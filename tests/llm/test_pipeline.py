"""The near-dedup stage and the pipeline against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from sheafline.llm import exact_dedup, simhash, sketch
from sheafline.llm.common import table


def shingles(t, k=5):
    words = (t or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_dedup_stage(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, far = [], []
    for k in range(60):
        base = list(rng.choice(words, 200))
        rows.append((k, " ".join(base)))
        for c, edits in enumerate((1, 3)):
            copy = list(base)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = "edit"
            rows.append((1000 + 10 * k + c, " ".join(copy)))
        half = base[:100] + list(rng.choice(words, 100))
        far.append((2000 + k, " ".join(half)))
    odd = [(5000, None), (5001, ""), (5002, ""), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + far + odd], "doc_id long, text string, node string").repartition(3)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == ["doc_id", "text", "node"]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [*range(60), *(i for i, _ in far), 5000, 5001, 5002, None]))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 200, 5000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 5 : n + n // 5])
        stored = [np.unique((x >> np.uint64(32)).astype("<u4"))[: sketch.SKETCH].tobytes() for x in (a, b)]
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(sketch.similarity(*stored) - exact) < (0.01 if n < 300 else 0.1)
    assert len(sketch.bands(sketch.slots(np.array([7], np.uint64)))) == sketch.BANDS


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == before.columns
        docs = docs.cache()
        seen[name] = docs.count()
        if name == "exact dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({exact_dedup.digest_hex(r.text) for r in before.collect()})
        if name == "near dedup":
            kept, every = {r.doc_id for r in docs.collect()}, {r.doc_id: shingles(r.text) for r in before.collect()}
            pairs = [(a, b) for a in every for b in every if a < b and len(every[a] & every[b]) >= 0.85 * len(every[a] | every[b]) > 0]
            assert not any(a in kept and b in kept for a, b in pairs)
    assert 0 < seen["near dedup"] <= seen["exact dedup"] <= seen["quality classifier"] <= 200
    got = docs.collect()
    assert {r.doc_id for r in got} and all(r.length <= 1024 for r in got)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in got}
