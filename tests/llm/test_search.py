"""Ranked search against brute force: all scores of all documents in whole numbers."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from sheafline.llm import search

SCHEMA = "doc_id long, text string, rank int, score long, item_id long"
ITEMS = "item_id long, text string, doc_id long, rank int"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.text("aB1é. _\x00\x7f你", max_size=12), max_size=8), st.integers(1, 9))
def test_terms_of_bytes(texts, piece):
    old, search.PIECE = search.PIECE, piece
    try:
        array = pa.array(texts, pa.string())
        assert search.term_counts(array).tolist() == [len(terms(t)) for t in texts]
        got = Counter()
        for found, code, doc, times in (search._postings(*p) for p in search._pieces(array)):
            for c, d, n in zip(code, doc, times, strict=True):
                got[found[int(c)].as_py().decode(), int(d)] += int(n)
        assert got == Counter((t, d) for d, text in enumerate(texts) for t in terms(text))
    finally:
        search.PIECE = old


def test_ties_are_safe():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        scores, ids, known = rng.integers(0, 4, n), rng.permutation(n), rng.random(n) < 0.8
        want = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], not known[i], ids[i]))[:5]
        assert search.best(scores, ids, known, 5).tolist() == want


def test_length_beyond_64_bits():
    n = np.array([0, 7, 10**13], np.int64)
    assert search._m(n, 10**9, 10**16).tolist() == [50 + 50 * int(x) * 10**9 // 10**16 for x in n]


DOCS = [(1, "Alpha beta beta, gamma"), (2, "alpha"), (3, "ALPHA"), (4, None), (5, ""), (6, "..."), (None, "alpha"), (None, "beta delta"), (7, "beta"), (7, "beta"), (8, "long " * 5000 + "alpha"), (9, "naïve ünïcode 你好"), (10, "Ünïcode x1")]
QUERIES = [(1, "alpha Beta alpha"), (2, None), (3, "nothing here"), (4, "ünïcode 你好 X1"), (4, "gamma"), (None, "delta alpha"), (5, "")]


def test_small(spark):
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in DOCS], SCHEMA).repartition(3)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in QUERIES], ITEMS)
    for k in (2, 50):
        assert ranked(search.rank_documents(docs, items, k)) == brute(DOCS, QUERIES, k)


def test_shards_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in DOCS], SCHEMA).repartition(2)
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in QUERIES], ITEMS)
    monkeypatch.setattr(search, "QUERIES", 2)
    n_docs, n_terms = search.totals(docs)
    index = search.build_index(docs, n_docs, n_terms, most_docs=2, most_postings=3)
    assert index.count() > 4 and index.agg({"n_docs": "sum"}).first()[0] == len(DOCS)
    assert ranked(search.search(index, n_docs, items, 3)) == brute(DOCS, QUERIES, 3)


def test_many_equal_scores(spark):
    rows = [(i, "copy of a text") for i in range(300, 0, -1)] + [(1000 + i, f"other {i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], SCHEMA).repartition(4)
    items = spark.createDataFrame([(1, "text copy", 0, 0), (2, "other 3", 0, 0)], ITEMS)
    assert ranked(search.rank_documents(docs, items)) == brute(rows, [(1, "text copy"), (2, "other 3")])


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a", 0, 0, 0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    items, no_items = spark.createDataFrame([(1, "a", 0, 0)], ITEMS), spark.createDataFrame([], ITEMS)
    assert search.rank_documents(none, items).count() == 0
    assert search.rank_documents(docs, no_items).count() == 0
    assert search.rank_documents(none, no_items).columns == ["item_id", "rank", "doc_id", "score"]


def test_whole_table(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    assert ranked(search.rank_documents(docs, items)) == brute(*rows)
