"""Sharding, exact dedup and token counts against brute force."""

from __future__ import annotations

import zlib
from collections import defaultdict
from math import log

import numpy as np
import pytest
import xxhash
from sheafline.llm import exact_dedup, sharding, tokens

SCHEMA = "doc_id long, text string, shard string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


EDGE = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b " * 5000), (6, "é\n"), (6, "é\n"), (None, "c"), (None, "a"), (7, "a"), (8, "d")]


def brute_shard(key, n):
    name = "\x00null" if key is None else str(key)
    units = [((xxhash.xxh64_intdigest(f"{name}:{i}".encode(), 42) >> 12) + 0.5) / 2**52 for i in range(n)]
    return int(np.argmax([-1 / log(u) for u in units]))


def test_shards_and_slots(spark):
    rows = sharding.shard_documents(docs(spark, EDGE + [(i, f"t{i % 7}") for i in range(100, 400)]), 16).collect()
    assert len(rows) == len(EDGE) + 300
    by = defaultdict(list)
    for r in rows:
        assert r.shard == brute_shard(r.doc_id, 16) and r.grown_shard == brute_shard(r.doc_id, 17)
        assert r.grown_shard in (r.shard, 16)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    long = next(r for r in rows if r.doc_id == 5)
    assert (long.size, long.text_crc32) == (10_001, zlib.crc32(b"b " * 5000))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}


def test_weights_and_empty(spark):
    ids = spark.range(4000).withColumnRenamed("id", "k")
    n = {r.shard: r["count"] for r in sharding.with_shards(ids, "k", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.4 < n[1] / n[0] < 3.7
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.with_shards(ids, "k", [0.0])


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, exact_dedup.digest_hex(t)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_keys,probes", [(20_000, 40_000), (3, 4)])
def test_exact_dedup(spark, monkeypatch, shard_keys, probes):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(exact_dedup, "PROBES", probes)
    rows = EDGE + [(100 + i, f"t{i % 40}") for i in range(120)] + [(300 + i, "hot") for i in range(60)]
    got = exact_dedup.dedup(docs(spark, rows))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got.collect()], key=str) == brute_dedup(rows)
    left = exact_dedup.drop_copies(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "shard", "digest"]
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert exact_dedup.dedup(docs(spark, [])).count() == 0


def test_history(spark):
    past = exact_dedup.dedup(docs(spark, [(900, "a"), (901, "zz")])).selectExpr("digest", "keep_id", "group_size")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs(spark, [(1, "a"), (2, "b"), (3, "b"), (950, "zz")]), past).collect()}
    assert got == {1: (900, 2), 2: (3, 2), 3: (3, 2), 950: (950, 2)}


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    slots = exact_dedup.mph_slots(exact_dedup.build_mph(keys), keys)
    assert sorted(slots.tolist()) == list(range(5000))


TEXTS = ["", None, "a b", "  lead and  trail \n\n", "x<|endoftext|>y z", "nospace" * 900, "word1 word2's " * 700, "é　ü\x1c\x85 !?" * 300, "日本語" * 1500, " " * 3000 + "end"]


@pytest.mark.parametrize("huge,overlap", [(10**9, 256), (50, 4), (50, 64)])
def test_token_counts(spark, monkeypatch, huge, overlap):
    monkeypatch.setattr(tokens, "OVERLAP", overlap)
    monkeypatch.setattr(tokens, "CHUNK", 500)
    monkeypatch.setattr(tokens.count_huge, "__defaults__", (tokens.VOCABULARY, overlap))
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (3, "a b")]
    got = tokens.count_documents(docs(spark, rows), huge=huge).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokens.count_documents(docs(spark, [])).count() == 0


def test_ids_by_blocks():
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    for t in TEXTS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert tokens.encode_ids(t or "").tolist() == want
        assert sum(len(library.encode(b, add_special_tokens=False).ids) for b in tokens.blocks(t or "", 40)) == len(want)


def test_merging_by_rank_is_proven(tmp_path):
    import json

    assert tokens.by_rank(tokens.VOCABULARY)

    def vocabulary(name, merges, extra=()):
        known = sorted("abcd")
        for m in merges:
            known.append("".join(m))
        spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {k: i for i, k in enumerate(known)}, "merges": [list(m) for m in merges]} | dict(extra)}
        path = tmp_path / name
        path.write_text(json.dumps(spec))
        return str(path)

    assert tokens.by_rank(vocabulary("good.json", [("a", "b"), ("ab", "c"), ("c", "d")]))
    # the bytes of abc come to ab c, but the listed merge is a bc: by rank, ab and c would be merged
    odd = vocabulary("odd.json", [("a", "b"), ("b", "c"), ("a", "bc")])
    assert not tokens.by_rank(odd)
    library = tokens.tokenizer(odd)[0]
    assert tokens.tokenizer(odd)[2] is None and list(tokens.tokenizer(odd)[1]("abc")) == library.encode("abc").ids == [4, 2]
    assert not tokens.by_rank(vocabulary("dropout.json", [("a", "b")], {"dropout": 0.1}))


def test_token_ends_of_both_libraries(monkeypatch):
    library = tokens.tokenizer(tokens.VOCABULARY)
    for t in [x or "" for x in TEXTS] + ["é" * 40, "a日b 本", "\U0001f600 x\U0001f600"]:
        fast = [np.asarray(x).tolist() for x in tokens.token_ends(t)]
        monkeypatch.setitem(tokens._loaded, tokens.VOCABULARY, (*library[:2], None))
        assert [np.asarray(x).tolist() for x in tokens.token_ends(t)] == fast
        monkeypatch.setitem(tokens._loaded, tokens.VOCABULARY, library)


def test_dealt_chunks(spark, monkeypatch):
    for name, value in {"CHUNK": 500, "DEAL": 2000, "DEALT": 3}.items():
        monkeypatch.setattr(tokens, name, value)
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    got = {r.doc_id: r.n_tokens for r in tokens.count_documents(docs(spark, list(enumerate(TEXTS))), huge=400).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
