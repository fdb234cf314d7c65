"""Files of token ids: round trips of blocks, files and documents against the tokenizer's library."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sheafline.llm import token_files, tokens

SCHEMA = "doc_id long, text string, start long, ids long, path string"


def docs(spark, rows, slices=3):
    return spark.createDataFrame([(i, t, 9, 9, "x") for i, t in rows], SCHEMA).repartition(slices)


def brute(rows):
    """(doc_id, n_tokens, crc) by doc_id, nulls first."""
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    out = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    rows, at = [], 0
    for i, n, crc in out:
        rows.append((i, at, n, crc))
        at += n
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=50))
def test_blocks(values):
    values = np.array(values, "<u4")
    control, data = token_files.pack_block(values)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert (token_files.unpack_block(control, data, len(values)) == values).all()


def test_damaged_block():
    control, data = token_files.pack_block(np.array([1, 2, 300], "<u4"))
    with pytest.raises(ValueError):
        token_files.unpack_block(control, data + b"x", 3)


def test_file_by_ranges(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 7)
    rng = np.random.default_rng(1)
    id_of = rng.permutation(1000).astype("<u4")
    rank_of = np.argsort(id_of).astype("<u4")
    texts = [(None if k == 0 else k, rng.integers(0, 1000, n)) for k, n in enumerate([3, 0, 0, 29, 7, 1, 0])]
    out = io.BytesIO()
    writer = token_files.FileWriter(out, rank_of)
    for i, ids in texts:
        writer.add(i, ids)
    writer.close()
    for span in (1, 5, 40, 1000):
        got = []
        for lo in range(0, 41, span):
            reader = token_files.FileReader(out, len(out.getvalue()), id_of)
            got += [(i, s, [int(x) for p in parts for x in p]) for i, s, parts in reader.documents(lo, None if lo + span > 40 else lo + span)]
        assert [(i, ids) for i, _, ids in got] == [(i, ids.tolist()) for i, ids in texts]
    broken = out.getvalue()[:-40] + b"\0" + out.getvalue()[-39:]
    with pytest.raises(ValueError):
        token_files.FileReader(io.BytesIO(broken), len(broken), id_of)


ROWS = [(5, "one two, three"), (1, None), (2, ""), (None, "no id"), (None, None), (3, "same"), (3, "same"), (3, "other"), (7, "<|endoftext|> inside"), (9, "żółć 你好 \U0001f600"), (4, "long words " * 9000), (8, "x" * 3000)]


@pytest.mark.parametrize("most", [token_files.FILE_IDS, 2000])
def test_round_trip(spark, most):
    files = token_files.write_files(docs(spark, ROWS), most=most)
    got = token_files.read_files(files, span=1000)
    assert [tuple(r) for r in got.orderBy("start").collect()] == brute(ROWS)
    # files follow one another: the smaller doc_id in the earlier file
    assert files.agg({"n_docs": "sum"}).first()[0] == len(ROWS)


def test_ids_come_back(spark):
    got = {r["doc_id"]: r["ids"] for r in token_files.read_files(token_files.write_files(docs(spark, ROWS[:3])), with_ids=True).collect()}
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in ROWS[:3]}


def test_frequent_ids_are_short(spark):
    rows = docs(spark, [(k, "many many rare" if k else "many") for k in range(20)])
    book = token_files.codebook(token_files.materialise(rows.selectExpr("doc_id", "doc_id uid", "text").mapInArrow(token_files._encode_batches(tokens.VOCABULARY, True, 2), token_files.ENCODED)))
    library = tokens.tokenizer(tokens.VOCABULARY)[0]
    count = {}
    for k in range(20):
        for x in [*library.encode("many many rare" if k else "many", add_special_tokens=False).ids, 2]:
            count[x] = count.get(x, 0) + 1
    assert book[: len(count)].tolist() == sorted(count, key=lambda x: (-count[x], x))
    assert sorted(book.tolist()) == list(range(len(book)))


def test_empty_table(spark):
    got = token_files.round_trip(docs(spark, []))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_files.round_trip(rows).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()])
