"""Every known licence sentence passes the anchor words."""

from __future__ import annotations

import itertools
import re
from re import _parser

from sheafline.llm import licenses


def variants(parsed):
    """Texts that a parsed pattern matches: every branch, with and without what is optional."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "SUBPATTERN":
            parts.append(variants(arg[-1]))
        elif op == "BRANCH":
            parts.append([v for branch in arg[1] for v in variants(branch)])
        elif op == "MAX_REPEAT":
            parts.append([v * n for n in {arg[0], min(arg[1], max(arg[0], 1))} for v in variants(arg[2])])
        else:
            parts.append([{"ANY": "x", "IN": "2"}[op]])
    return ["".join(p) for p in itertools.product(*parts)]


def test_every_sentence_has_an_anchor():
    for name, pattern in licenses.SENTENCES:
        for v in variants(_parser.parse(pattern)):
            assert re.search(licenses.ANCHORS, v), (name, v)


def test_sentences_without_older_anchors(spark):
    texts = {
        "Released under CC BY 4.0.": "CC-BY-4.0",
        "Distributed under CC-BY-SA 4.0.": "CC-BY-SA-4.0",
        "Released under Creative Commons Attribution-NonCommercial 4.0.": "CC-BY-NC-4.0",
        "Released under CC0 1.0 Universal.": "CC0-1.0",
        "Dedicated to the public\ndomain.": "CC0-1.0",
        "Licensed under CC\n# BY 4.0": "CC-BY-4.0",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "x.\nAll rights\n# reserved."])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].licenses for i in range(len(texts))] == list(texts.values())
    assert got[len(texts)].sentence_ids == "rights"
