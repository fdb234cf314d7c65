"""Repair of conversations against all edits of short ones, and against a plain reading of the rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

from sheafline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, head string, letters string"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
GOOD = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) out of all edits, with two insertions at a place at most."""
    best = None
    inserts = [list(p) for n in range(3) for p in product(("user", "assistant"), repeat=n)]
    ways = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        own = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        ways.append([(c + 3 * len(i), "I" * len(i) + e, [(r, "") for r in i] + ([x] if x else [])) for c, e, x in own for i in inserts])
    ways.append([(3 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts])
    for way in product(*ways):
        cost, edits, lines = sum(w[0] for w in way), "".join(w[1] for w in way), [x for w in way for x in w[2]]
        if (best is None or (cost, edits) < best[:2]) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
            best = cost, edits, lines
    return best


def audited(rows):
    signature = "".join(repair.letter(r[:1], ("", "blank", "duplicate", "truncated").index(f)) for (r, _), f in zip(rows, faults(rows), strict=True))
    return repair.audit(signature)


def test_all_edits_of_short_conversations():
    texts = ["Done.", "cut", " "]
    for n in (0, 1, 2):
        for roles in product(("system", "user", "assistant", "tool"), repeat=n):
            for said in product(texts, repeat=n):
                rows = list(zip(roles, said, strict=True))
                assert audited(rows)[4:] == cheapest(rows)[:2], rows
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "x"]), rng.choice(["A.", "B!", "cut", "", "A."])) for _ in range(3)]
        assert audited(rows)[4:] == cheapest(rows)[:2], rows


def simple(signature):
    """(cost, audit) from the right end, every state's whole string kept."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for char in reversed(signature):
        fault, role = divmod(ord(char) - 97, 4)
        options = {s: [(best[s][0] + 4, "D" + best[s][1])] for s in best}
        if fault in (0, 3):
            for s, own in options.items():
                for edit, to in (("R", nxt[s]), ("K", 1 if role == 0 and s == 0 else role + 1 if role in (1, 2) and nxt[s] == role + 1 else None)):
                    if to is not None:
                        own.append((best[to][0] + COST[edit] + 3 * (fault == 3), edit + best[to][1]))
        now = {s: min(o) for s, o in options.items()}
        for _ in range(4):
            now = {s: min(now[s], (now[nxt[s]][0] + 3, "I" + now[nxt[s]][1])) for s in now}
        best = now
    return best[0]


def test_long_signatures():
    rng = random.Random(4)
    for n in (1, 5, 31, 32, 33, 200, 1000):
        for _ in range(10):
            signature = "".join(rng.choice("abcdefghijklmnop"[: rng.choice([4, 16])]) for _ in range(n))
            assert repair.audit(signature)[4:] == simple(signature)
    assert len(repair.audit("bc" * 100_000)[5]) == 200_000


def brute(rows):
    """The whole contract, row by row, for (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        said = [(r, t) for _, r, t in held]
        turns = {t for t, _, _ in held if t is not None}
        first = faults(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, edits = simple("".join(repair.letter(r[:1], ("", "blank", "duplicate", "truncated").index(f)) for (r, _), f in zip(said, first, strict=True)))
        lines, left, state = [], list(said), 0
        for e in edits:
            expected = "assistant" if state == 2 else "user"
            if e != "I":
                role, text = left.pop(0)
            if e == "D":
                continue
            if e == "K":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            else:
                lines.append(f"{expected}:{text if e == 'R' else ''}")
                state = 3 if state == 2 else 2
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(first.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def made(spark, rows, slices=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(slices)


def odd_rows():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Who?"), (None, 1, "user", "Who?"), (1, None, "user", "."), (2, 5, "", "x."), (3, 0, "User", "A."), (3, 9, "unit", "B.\n"), (4, 3, "user", "long " * 40_000)]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 9)):
            rows += [(conv, None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 3]), rng.choice(["system", "user", "assistant", None, "tool"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], rng.choice(["Yes.", "No!", "cut", None, "\t\n", f"t{turn}?"]))]
    rows += [r for r in rows if rng.random() < 0.2]
    rows += [(70, None, "user", "same.")] * 40 + [(71, t, "user", "same.") for t in range(40)] + [(72, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(60)]
    return rows


def test_rules(spark):
    rows = odd_rows()
    assert found(repair.repair_conversations(made(spark, rows))) == brute(rows)


def test_segments(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(repair, "SENT", 0)
    letters = repair.letters_of(repair.damage(made(spark, rows)))
    whole = {r["conv_id"]: r["signature"] for r in repair.signatures(letters).collect()}
    monkeypatch.setattr(repair, "SEGMENT", 3)
    assert {r["conv_id"]: r["signature"] for r in repair.signatures(letters).collect()} == whole
    assert found(repair.repair_conversations(made(spark, rows, 7))) == brute(rows)


def test_every_row_is_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(repair.repair_conversations(made(spark, [(gone, 0, "user", "Hi.")])))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    got = repair.repair_conversations(made(spark, []))
    assert got.columns == COLUMNS and got.count() == 0


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(repair.repair_conversations(rows)) == brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
