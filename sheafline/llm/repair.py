"""Repair of conversations whose turns are blank, repeated, cut short or out of order, at the least cost.

A row of a conversation is one letter: the initial of its role (system, user, assistant, or another) and its first
fault. The letters of a conversation in order are its signature. All that an audit says is a function of the
signature, and few signatures differ, so each distinct one is solved once, audits are joined back, and a last pass
replays the edits on the texts.

Rows are put in order by ranges that may cut a conversation, which yields signatures in segments; only letters of one
conversation come together. The replay streams the sorted rows of each conversation; its digest is one sequence, so the
rows of one conversation pass through one task, which holds a batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Letters of a segment, and up to how many letters solutions are kept; kept solutions of a task.
SEGMENT = 4_096
SHORT = 32
KEPT = 65_536
#: Bytes of solved signatures that are broadcast to conversations, at most; beyond, they are joined by a shuffle.
SENT = 33_554_432

# What a blank is, and what ends a text.
BLANK = r"[\x20\x09-\x0D]"
ENDS = ".!?"

#: A letter is 4 x fault + initial, counted from "a".
INITIALS = "sua"
NONE, IS_BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
UNFINISHED = 3

# States of the roles so far: none, a system turn, last a user, last an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that must come next, a user's or an assistant's.
NEXT = (USER, USER, ASSISTANT, USER)
#: What is still to be inserted at the end of a conversation.
END = (0, 6, 3, 0)


def letter(initial: str, fault: int) -> str:
    return chr(97 + 4 * fault + (INITIALS.index(initial) if initial in INITIALS and initial else 3))


def _kept(state: int, initial: int) -> int | None:
    """The state after a turn that is kept."""
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial in (1, 2) and NEXT[state] == initial + 1 else None


@lru_cache(maxsize=None)
def _turn(char: str, tail: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """One letter before ``tail``, the costs of what follows by state: own costs, and for each state the edits up to and with this turn and the state after it."""
    fault, initial = divmod(ord(char) - 97, 4)
    left = UNFINISHED if fault == TRUNCATED else 0

    def options(state: int) -> list[tuple[int, str, int]]:
        out = [(COST["D"] + tail[state], "D", state)]
        if fault in (NONE, TRUNCATED):
            kept = _kept(state, initial)
            if kept is not None:
                out.append((left + tail[kept], "K", kept))
            out.append((COST["R"] + left + tail[NEXT[state]], "R", NEXT[state]))
        return out

    costs = [min(options(s))[0] for s in range(4)]
    for _ in range(3):  # an insertion leads to a state of this turn; it pays twice at most
        costs = [min(costs[s], COST["I"] + costs[NEXT[s]]) for s in range(4)]
    moves = []
    for state in range(4):
        edits = ""
        while True:  # of the cheapest, the least letter; each insertion makes the rest cheaper, so this ends
            ways = [(e, to) for c, e, to in options(state) if c == costs[state]]
            if COST["I"] + costs[NEXT[state]] == costs[state]:
                ways.append(("I", NEXT[state]))
            edit, state = min(ways)
            edits += edit
            if edit != "I":
                break
        moves.append((edits, state))
    return tuple(costs), tuple(moves)


def _solve(letters: str, tail: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs of ``letters`` before ``tail`` by the state before them, and for each the edits and the state after them."""
    if len(letters) == 1:
        return _turn(letters, tail)
    half = len(letters) // 2
    costs, after = _part(letters[half:], tail)
    costs, before = _part(letters[:half], costs)
    return costs, tuple((edits + after[state][0], after[state][1]) for edits, state in before)


_short = lru_cache(maxsize=KEPT)(_solve)


def _part(letters: str, tail: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """``_solve`` with costs counted from the least, so that equal parts of conversations meet; short parts are solved once."""
    least = min(tail)
    costs, moves = (_short if len(letters) <= SHORT else _solve)(letters, tuple(t - least for t in tail))
    return tuple(c + least for c in costs), moves


def audit(signature: str) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, edits) of a signature.

    Edits are K(eep), R(erole), D(elete) and I(nsert), the cheapest that leave roles ``(s?(ua)+)?``; of equally cheap
    ones those that come first in ASCII. At each turn the edits that may come next have different letters, so the first
    of them decides.
    """
    faults = [sum(signature.count(chr(97 + 4 * f + i)) for i in range(4)) for f in (IS_BLANK, DUPLICATE, TRUNCATED)]
    roles = signature.translate({97 + 4 * f + i: "suax"[i] for f in range(4) for i in range(4)})
    illegal = max(0, len(roles) - 1) - sum(a + b in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    if not signature:
        return 0, 0, 0, 0, 0, ""
    costs, moves = _part(signature, END)
    edits, state = moves[START]
    return *faults, illegal, costs[START], edits + "I" * (END[state] // COST["I"])


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of ``rows(conv_id, turn, role, text)``, damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ends of sentences out, 3 repeats it, 4 makes its role ``user``. Nulls in
    role and text, and in the string that is hashed, are one space; conv_id and turn themselves stay null.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    out = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
        kind.alias("kind"),
    )
    return out.where("kind <> 0").drop("kind")


def _order() -> list[Column]:
    """Conversations, and the rows of each in order."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def letters_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, first, copies``: equal rows of a turn as one, with the letter of the first and their number.

    Texts stay where they are read: only their digests go through the shuffle. Rows are added up before it, and texts that
    return in later turns are found by the least turn of each, so that no group of copies comes to one task.
    """
    text = F.rtrim(F.regexp_replace("text", BLANK, " "))
    slim = rows.select(
        "conv_id",
        "turn",
        "role",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.when(text == "", IS_BLANK).when(F.instr(F.lit(ENDS), F.right(text, F.lit(1))) == 0, TRUNCATED).otherwise(NONE).alias("fault"),
        "copies",
    )
    slim = materialise(slim.groupBy("conv_id", "turn", "role", "digest").agg(F.first("fault").alias("fault"), F.sum("copies").alias("copies")))
    # nulls come first, as they do in the order of turns
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = slim.groupBy(F.col("conv_id").alias("in_conv"), F.col("role").alias("in_role"), F.col("digest").alias("in_digest")).agg(F.min(turn).alias("least"), F.count("*").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("role") == F.col("in_role")) & (F.col("digest") == F.col("in_digest"))
    joined = slim.join(firsts.where("n > 1"), same, "left").withColumn("again", F.coalesce(F.col("least") < turn, F.lit(False)))
    fault = F.when(F.col("fault") == IS_BLANK, IS_BLANK).when(F.col("again"), DUPLICATE).otherwise(F.col("fault"))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    return joined.select("conv_id", "turn", "role", "digest", (4 * fault + initial).alias("first"), "copies")


SEGMENTS = "conv_id long, turn long, role string, digest string, skip long, letters string"


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the signatures of sorted rows; each names the row, and the copy of it, that it begins with."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split(" ")[0] for c in SEGMENTS.split(", ")]
    held, out = None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for r in batch.to_pylist():
            code, skip, left = r["first"], 0, r["copies"]
            # copies after the first are duplicates, but blank ones are blank
            again = code if code // 4 in (IS_BLANK, DUPLICATE) else 4 * DUPLICATE + code % 4
            while left:
                if held is None or held[0] != r["conv_id"] or len(held[5]) >= SEGMENT:
                    out += [(*held[:5], "".join(held[5]))] if held else []
                    held = [r["conv_id"], r["turn"], r["role"], r["digest"], skip, []]
                n = min(left, SEGMENT - len(held[5]))
                held[5] += [chr(97 + (code if skip == 0 else again)), *[chr(97 + again)] * (n - 1)]
                skip, left = skip + n, left - n
                if len(out) >= 256:
                    yield flush()
                    out = []
    out += [(*held[:5], "".join(held[5]))] if held else []
    if out:
        yield flush()


def signatures(letters: DataFrame) -> DataFrame:
    """``conv_id, signature`` of the rows of ``letters_of``. Ranges of rows are sorted, each in a task of its own."""
    segments = letters.repartitionByRange(*_order()).sortWithinPartitions(*_order()).select("conv_id", "turn", "role", "digest", "first", "copies").mapInArrow(_segment_batches, SEGMENTS)
    part = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "skip", "letters")
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["letters"]), "").alias("signature"))


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        solved = list(zip(*(audit(s) for s in batch["signature"].to_pylist()), strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch["signature"], *(pa.array(list(c), t) for c, t in zip(solved, kinds, strict=True))], [c.split(" ")[0] for c in SOLVED.split(", ")])


def audits(signed: DataFrame) -> DataFrame:
    """``signed(conv_id, signature)`` with the audit of each; every distinct signature is solved once."""
    solved = materialise(signed.select("signature").distinct().mapInArrow(_audit_batches, SOLVED))
    size = solved.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
    return signed.join(F.broadcast(solved) if size <= SENT else solved, "signature")


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Replay:
    """The edits of one conversation, as its rows come in."""

    def __init__(self, head: dict):
        self.head, self.edits, self.at, self.state, self.parts = head, head["audit"], 0, START, 0
        self.hash = hashlib.sha256()

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.parts else ''}{role}:{text}".encode())
        self.parts += 1

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._say("user" if self.state == USER else "assistant", "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            self._say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._say("user" if self.state == USER else "assistant", text)

    def result(self) -> tuple:
        self._insert()
        if self.at != len(self.edits):
            raise ValueError(f"{len(self.edits) - self.at} edits of conversation {self.head['conv_id']} have no row")
        return *(self.head[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), self.hash.hexdigest()


def _replay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split(" ")[0] for c in REPAIRED.split(", ")]
    held, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["head"]:
                out += [held.result()] if held else []
                held = _Replay(r["head"] | {"conv_id": r["conv_id"]})
            else:
                for _ in range(r["copies"]):
                    held.row(r["role"], r["text"])
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    out += [held.result()] if held else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def repair(original: DataFrame, damaged: DataFrame) -> DataFrame:
    """An audit for every conv_id of ``original``, and the digest of its repaired turns, from ``damaged(conv_id, turn, role, text, copies)``.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are in order of turn
    (nulls first), rows of one turn by role and by the digest of their text. A null conv_id is a conversation like others.
    A role that is empty, or begins with neither s, u nor a, is illegal beside any, and is reroled or deleted. Equal rows
    of a turn are duplicates of the first. A conversation without rows has zeros, no edits and the digest of the empty
    string. Other columns are ignored; an empty table gives an empty table.
    """
    letters = materialise(letters_of(damaged))
    solved = audits(materialise(signatures(letters)))
    turns = letters.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = ids.join(solved, ids["conv_id"].eqNullSafe(solved["conv_id"]), "left").select(ids["conv_id"], "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    heads = heads.join(turns, heads["conv_id"].eqNullSafe(turns["conv_id"]), "left").select(heads["*"], turns["gaps"])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    heads = heads.select("conv_id", F.struct(*numbers, F.coalesce("audit", F.lit("")).alias("audit")).alias("head"))
    nothing = F.lit(None)
    rows = damaged.select("conv_id", nothing.alias("head"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text", F.col("copies").cast("long").alias("copies"))
    heads = heads.select("conv_id", "head", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("digest"), nothing.cast("string").alias("text"), nothing.cast("long").alias("copies"))
    conv, *within = _order()
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(conv, F.col("head").isNull(), *within)
    return stream.select("conv_id", "head", "role", "text", "copies").mapInArrow(_replay_batches, REPAIRED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations(conv_id, turn, role, text)`` by rule, then audits and repairs each; see ``damage`` and ``repair``."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair(rows, damage(rows))
