"""The ordinal classifier: held-out accuracy, gradients and edge cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from sheafline.llm import quality

SCHEMA = "doc_id long, text string, grade string, kept string"


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for k in range(n):
        grade = int(rng.choice(3, p=[0.15, 0.15, 0.7]))
        text = list(rng.choice(words, rng.integers(30, 200)))
        if grade == 1:
            text.insert(int(rng.integers(0, 30)), "vile" + str(rng.choice(["ness", "ly", "st"])))
        rows.append((k, "!! ".join(text).upper() if grade == 0 else " ".join(text), grade))
    return rows


def test_held_out_and_pipeline_filter(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(5000, None, "", ""), (5001, "", "", ""), (None, "a b", "", "")], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1), "z") for i, _, g in rows if i < 1000] + [(None, 1, 0, "z"), (3, None, 0, "z")], "doc_id long, quality int, toxic int, text string")
    model = quality.train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.score(docs, model).collect()
    assert len(got) == 1503
    truth = {i: g for i, _, g in rows if i >= 1000}
    right = [r.kept == (truth[r.doc_id] == 2) for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 for r in got)
    left = quality.drop_rejected(docs, model)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", ""), (2, None, "", "")], SCHEMA)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.kept for r in quality.score(docs, model).collect()] == [True, True]


def test_gradients():
    rng = np.random.default_rng(2)
    grade, s, cuts = rng.integers(0, 3, 20), rng.normal(0, 2, 20), np.array([-np.inf, -0.7, 1.1, np.inf])

    def loss(s, cuts):
        return -np.log(quality._sigmoid(cuts[grade + 1] - s) - quality._sigmoid(cuts[grade] - s))

    by_score, by_upper, by_lower = quality._residuals(s, grade, cuts)
    assert np.allclose(by_score, (loss(s + 1e-6, cuts) - loss(s - 1e-6, cuts)) / 2e-6, atol=1e-5)
    for k in (1, 2):
        up, down = cuts.copy(), cuts.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        want = (loss(s, up) - loss(s, down)) / 2e-6
        assert np.allclose(np.where(grade + 1 == k, by_upper, 0) + np.where(grade == k, by_lower, 0), want, atol=1e-5)


def test_features_once_each():
    row, code = quality.features(pa.array(["a b a b aaaaa aaaaab", None, ""]))
    assert len(set(zip(row.tolist(), code.tolist(), strict=True))) == len(row)
    model = quality.fit(np.array([0, 1]), np.array([5, 6]), np.array([2, 0]), steps=3)
    assert np.isfinite(model.thresholds).all()


def plain_features(text):
    """The features of a text, one by one."""
    import math
    import re

    import xxhash

    text = text or ""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    shape = (1 << quality.BITS) - (len(quality.SHARES) + 3) * quality.STEPS
    found = {xxhash.xxh64_intdigest(f"{most}:{w[:most]}") % shape for w in words for most in (None, *quality.PREFIXES)}
    patterns = ("[A-Z]", r"[^\w\s]|_", r"\d", r"\n", r"[|#$%&*!]")
    n, chars = len(words), max(1, len(text))
    measures = [math.sqrt(len(re.findall(p, text)) / chars) * quality.STEPS for p in patterns]
    measures += [len(set(words)) / max(1, n) * quality.STEPS, chars / max(1, n) * 2, math.log2(n + 1)]
    return found | {shape + k * quality.STEPS + int(min(max(m, 0), quality.STEPS - 1)) for k, m in enumerate(measures)}


def test_scores_against_brute_force(spark):
    """Every row of the query's result by plain Python: features one by one, the sum of their weights, the link function."""
    import math

    rng = np.random.default_rng(11)
    rows = [(i, t) for i, t, _ in corpus(120, 5)] + [(900, None), (901, ""), (902, " .. \n"), (903, "Été, 12 $ & naïve\n\nÉTÉ"), (904, "x" * 50_000), (905, "one two " * 9000), (None, "a b"), (905, "one two " * 9000)]
    model = quality.Model(rng.normal(0, 0.3, 1 << quality.BITS), np.array([-0.8, 0.9]))
    want = []
    for i, t in rows:
        score = math.fsum(model.weights[f] for f in plain_features(t))
        one, two = (1 / (1 + math.exp(cut - score)) for cut in (-0.8, 0.9))
        want.append((str(i), round(one + two, 9), round(two, 9), two >= quality.KEEP))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [(str(r.doc_id), round(r.expected_grade, 9), round(r.p_good, 9), r.kept) for r in quality.score(docs, model).collect()]
    assert sorted(got) == sorted(want) and len({k[3] for k in got}) == 2


def test_fit_against_plain_descent():
    """The fitted likelihood is that of plain gradient descent on the same few features."""
    rng = np.random.default_rng(13)
    n = 400
    has = rng.random((n, 6)) < 0.4
    latent = has @ np.array([2.0, -2.0, 1.5, 0, 0, 0]) + rng.logistic(size=n)
    grade = (latent > -0.5).astype(int) + (latent > 1)
    row, code = np.nonzero(has)
    model = quality.fit(row, code, grade, screen=0.0, shrink=0.0)

    def loss(w, cuts):
        cuts = np.concatenate(([-np.inf], cuts, [np.inf]))
        s = has @ w
        return -np.log(quality._sigmoid(cuts[grade + 1] - s) - quality._sigmoid(cuts[grade] - s)).mean()

    x = np.array([0.0] * 6 + [-0.5, 1.0])
    for _ in range(4000):
        step = np.array([(loss(*np.split(x + e, [6])) - loss(*np.split(x - e, [6]))) / 2e-6 for e in 1e-6 * np.eye(8)])
        x -= 0.5 * step
        if np.abs(step).max() < 1e-6:
            break
    assert abs(loss(model.weights[:6], model.thresholds) - loss(*np.split(x, [6]))) < 1e-4


def test_features_on_the_driver_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRONG", 7)
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows], "doc_id long, quality int, toxic int")
    assert 0 < (quality.train(docs, labels).weights != 0).sum() <= 7
