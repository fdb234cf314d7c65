"""Decontamination: every placement of substitutions, long items and spans against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from sheafline.llm import decontam


@pytest.mark.parametrize("length", range(1, 21))
def test_masks_leave_no_placement_out(length):
    window = min(length, decontam.WINDOW)
    masks = decontam.masks_of(length)
    for places in itertools.combinations(range(window), window - decontam.needed(window)):
        assert any(all(x == "0" or at + i not in places for i, x in enumerate(mask)) for mask in masks for at in range(window - len(mask) + 1)), places


def brute(doc: list[str], item: list[str]) -> tuple | None:
    """(first word in the document, first in the item, words, of which agree) of the best run of good windows."""
    w = min(decontam.WINDOW, len(item))
    best = None
    for shift in range(-len(item), len(doc) + 1) if w else ():
        same = {p: doc[p] == item[p - shift] for p in range(max(0, shift), min(len(doc), len(item) + shift))}
        good = [p for p in same if p + w - 1 in same and sum(same[p + k] for k in range(w)) >= decontam.needed(w)]
        for _, run in itertools.groupby(enumerate(good), lambda x: x[1] - x[0]):
            places = [p for _, p in run]
            held = [p for p in range(places[0], places[-1] + w) if same[p]]
            case = (-len(held), held[-1] - held[0] + 1, held[0], held[0] - shift)
            best = min(best or case, case)
    return best and (best[2], best[3], best[1], -best[0])


def found(block, texts):
    import pyarrow as pa

    rows = block.verified(*decontam.word_hashes(pa.array(texts, pa.string())))
    return {(int(r[0]), int(block.ids[r[1]])): tuple(int(x) for x in r[2:]) for r in rows}


@pytest.mark.parametrize("hits", [200_000, 7])
def test_spans_against_brute_force(hits, monkeypatch):
    monkeypatch.setattr(decontam, "HITS", hits)
    rng = np.random.default_rng(6)
    for size in (2, 6, 300):  # of so few words, texts agree in many places
        words = [f"w{i}" for i in range(size)]
        items = [list(rng.choice(words, n)) for n in (1, 3, 5, 8, 9, 10, 12, 13, 14, 30, 60)]
        docs = [list(rng.choice(words, int(n))) for n in rng.integers(0, 60, 12)]
        for item in items:
            host, part = list(rng.choice(words, 40)), list(item)
            for at in rng.choice(len(part), len(part) // 6, replace=False):
                part[at] = "other"
            docs += [host[:20] + part + host[20:], part, part[: len(part) // 2] + host]
        block = decontam.Block(list(range(len(items))), [" ".join(i) for i in items])
        want = {(t, m): b for t, d in enumerate(docs) for m, i in enumerate(items) if (b := brute(d, i))}
        assert found(block, [" ".join(d) for d in docs]) == want


def test_a_long_item_is_one_overlap_and_a_gap_makes_two():
    rng = np.random.default_rng(7)
    item = [f"w{i}" for i in rng.integers(0, 5000, 500)]
    broken = item[:40] + ["x"] * 20 + item[60:90]
    block = decontam.Block([4], [" ".join(item)])
    assert found(block, [" ".join(["a", "b", *item, "c"]), " ".join(broken)]) == {(0, 4): (2, 0, 500, 500), (1, 4): (0, 0, 40, 40)}


def test_least_leaves_short_items_out(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "none of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three"), (2, "two three four five six"), (3, "one two three four five six seven")], "item_id long, text string")
    assert {r.item_id for r in decontam.overlaps(docs, bench).collect()} == {1, 2, 3}
    assert {r.item_id for r in decontam.overlaps(docs, bench, least=5).collect()} == {2, 3}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, bench, least=9).collect()] == [1, 2]
