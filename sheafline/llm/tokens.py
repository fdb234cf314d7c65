"""Token counts and ids of whole texts, exactly as the tokenizer library gives them.

Byte-level BPE first cuts a text into words and merges inside each. A place between a character that is no white
space and one that is can't be inside such a word, whatever stands further left or right: it is a *stable
boundary*. Hence a text's tokens are the tokens of its segments between stable boundaries, one after another.
Short texts are encoded in blocks that end at stable boundaries, so memory stays bounded.

Long texts are cut into overlapping chunks; those of very long ones are dealt out to many tasks. Each chunk is encoded
with offsets, and reports the stable boundaries that are token boundaries in its overlaps, with the number of tokens
before each. Neighbours are spliced at the first boundary both report. Where they share none, the document goes again
with wider overlaps, until its chunk is the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Characters from which a text is cut into chunks, and of a chunk without its overlaps.
HUGE = 8_192
CHUNK = 8_192
#: Characters from which the chunks of a text are dealt out to other tasks, and chunks of such a task.
DEAL = 262_144
DEALT = 64
#: Characters that are encoded at once.
BLOCK = 65_536
#: Characters of the first overlap to each side, and times it grows each time that alignment fails.
OVERLAP = 256
WIDEN = 16
VOCABULARY = "byte_bpe_50k.json"

# The characters that the tokenizer's pattern calls white space (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

_loaded: dict[str, tuple] = {}
_proven: dict[str, bool] = {}


def path_of(vocabulary: str) -> str:
    """The file of a name of ``public_tokenizers``, or of a path."""
    import public_tokenizers

    return vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)


def _spec(vocabulary: str) -> tuple[dict, dict, dict]:
    """The file's contents, its special tokens, and its other tokens as bytes with their ids."""
    with open(path_of(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # byte-level vocabularies write each byte as a printable character: itself, or the next from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return spec, special, {bytes(byte_of.get(c, 0) for c in k): v for k, v in spec["model"].get("vocab", {}).items() if k not in special}


def by_rank(vocabulary: str) -> bool:
    """Whether merging the adjacent tokens whose joint token has the least id gives the ids of the vocabulary's merges.

    The library only merges pairs that are listed. Both do the same if each listed merge makes the token of its own
    rank, and if the bytes of each token, merged by lower ranks alone, come to just the two parts of its listed merge:
    what lies between two token ends has then been merged as if it stood alone, so no other pair can give that token.
    All tokens are tried. The driver does it once and tells the tasks.
    """
    if vocabulary not in _proven:
        _proven[vocabulary] = _by_rank(vocabulary)
    return _proven[vocabulary]


def _by_rank(vocabulary: str) -> bool:
    with open(path_of(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or odd or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        return False
    ids = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in spec.get("added_tokens", [])}}
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    first = len(ids) - len(pairs)
    if first < 1 or any(len(k) > 1 for k, v in ids.items() if v < first):
        return False
    for i, pair in enumerate(pairs):
        rank = ids.get("".join(pair))
        if rank != first + i:
            return False
        parts = list("".join(pair))
        while len(parts) > 2:
            joint = [ids.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(joint)), key=joint.__getitem__)
            if joint[k] >= rank:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if tuple(parts) != pair:
            return False
    return True


def tokenizer(vocabulary: str, ranked: bool | None = None) -> tuple:
    """(library, encode, widths) for a file name of ``public_tokenizers``, or for a path.

    The library defines the result. Where ``by_rank`` holds, ``encode`` is a second library that merges by rank, four
    times as fast, and ``widths`` holds the bytes of each id; for any other vocabulary it is the first library, and
    ``widths`` is None.
    """
    if vocabulary not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path_of(vocabulary))
        fast = by_rank(vocabulary) if ranked is None else ranked
        _loaded[vocabulary] = (library, *(_ranked(vocabulary) if fast else ((lambda x: library.encode(x, add_special_tokens=False).ids), None)))
    return _loaded[vocabulary]


def _ranked(vocabulary: str) -> tuple:
    import public_tokenizers
    import tiktoken

    _, special, ranks = _spec(vocabulary)
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    widths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    widths[list(ranks.values())] = [len(k) for k in ranks]
    widths[list(special.values())] = [len(k.encode()) for k in special]
    marks = tuple(special)

    def encode(text: str) -> np.ndarray:
        return coder.encode_to_numpy(text, allowed_special=set(m for m in marks if m in text), disallowed_special=())

    return encode, widths


def token_ends(text: str, vocabulary: str = VOCABULARY) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of tokens of a text; the characters before each token end that is a character's end; the tokens before each."""
    library, encode, widths = tokenizer(vocabulary)
    if widths is None:
        ends = np.array([b for _, b in library.encode(text, add_special_tokens=False).offsets], np.int64)
        # offsets count characters; of tokens that share one, only the last ends at its end
        last = np.append(ends[1:] > ends[:-1], True) if len(ends) else np.zeros(0, bool)
        return len(ends), ends[last], np.flatnonzero(last) + 1
    ids = encode(text)
    ends, n = np.cumsum(widths[ids]), np.arange(1, len(ids) + 1)
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) > len(text):
        begins = np.append((data & 0xC0) != 0x80, True)
        whole = begins[ends]
        ends, n = (np.cumsum(begins) - begins)[ends[whole]], n[whole]
    return len(ids), ends, n


def blocks(text: str, most: int = BLOCK) -> Iterator[str]:
    """The text in blocks of about ``most`` characters that end at stable boundaries; longer where there are none."""
    at = 0
    while len(text) - at > most:
        found = STABLE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; memory is bounded by its blocks."""
    encode = tokenizer(vocabulary)[1]
    return sum(len(encode(block)) for block in blocks(text))


def encode_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers."""
    encode = tokenizer(vocabulary)[1]
    return np.concatenate([np.asarray(encode(block), "<u4") for block in blocks(text)])


def _count_batches(vocabulary: str, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer(vocabulary, ranked)
        for batch in batches:
            n = [count_tokens(x or "", vocabulary) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


CHUNKS = "uid long, piece long, pieces long, start long, cut_from long, cut_to long, chunk string"


def _cut_batches(overlap: int):
    """Chunks of CHUNK characters with ``overlap`` characters on both sides; a document that is shorter than twice its overlap is one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch["uid"].to_pylist(), batch["text"].to_pylist(), strict=True):
                size = CHUNK if 2 * overlap < len(text) else len(text)
                pieces = max(1, -(-len(text) // size))
                for first in range(0, pieces, 64):
                    rows = []
                    for k in range(first, min(pieces, first + 64)):
                        a, b = max(0, k * size - overlap), min(len(text), (k + 1) * size + overlap)
                        rows.append((uid, k, pieces, a, k * size, min(len(text), (k + 1) * size), text[a:b]))
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string())], ["uid", "piece", "pieces", "start", "cut_from", "cut_to", "chunk"])

    return run


ENCODED = "uid long, piece long, pieces long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def _encode_batches(vocabulary: str, overlap: int, ranked: bool):
    """Each chunk's number of tokens, and the token boundaries in its overlaps that are stable, with the tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer(vocabulary, ranked)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                total, places, before = token_ends(r["chunk"], vocabulary)
                stable = np.array([m.start() for m in STABLE.finditer(r["chunk"])], np.int64)
                good = np.isin(places, stable)
                at, n = places[good] + r["start"], before[good]
                head = (at >= r["cut_from"] - overlap) & (at <= r["cut_from"] + overlap) & (r["piece"] > 0)
                tail = (at >= r["cut_to"] - overlap) & (at <= r["cut_to"] + overlap) & (r["piece"] + 1 < r["pieces"])
                out.append((r["uid"], r["piece"], r["pieces"], total, at[head].tolist(), n[head].tolist(), at[tail].tolist(), n[tail].tolist()))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["uid", "piece", "pieces", "n", "head", "head_n", "tail", "tail_n"])

    return run


def splice(encoded: DataFrame) -> DataFrame:
    """``uid, n_tokens`` of each document; n_tokens is null where two neighbours share no stable boundary."""
    by_piece = Window.partitionBy("uid").orderBy("piece")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(by_piece)))
    spliced = encoded.withColumn("from", common)
    spliced = spliced.withColumn("to", F.lead("from").over(by_piece))

    def tokens_before(places: str, counts: str, at: str) -> F.Column:
        return F.try_element_at(F.col(counts), F.array_position(places, F.col(at)).cast("int"))

    # a splice that is missing leaves null, as array_position is then null
    first = F.when(F.col("piece") == 0, F.lit(0)).otherwise(tokens_before("head", "head_n", "from"))
    last = F.when(F.col("piece") + 1 == F.col("pieces"), F.col("n")).otherwise(tokens_before("tail", "tail_n", "to"))
    own = spliced.select("uid", (last - first).alias("own"))
    return own.groupBy("uid").agg(F.when(F.count("*") == F.count("own"), F.sum("own")).alias("n_tokens"))


def count_huge(docs: DataFrame, vocabulary: str = VOCABULARY, overlap: int = OVERLAP) -> DataFrame:
    """``uid, n_tokens`` of ``docs(uid, text)``, by chunks; those of texts of DEAL characters are dealt out to tasks of their own."""
    left, done, ranked = docs, None, by_rank(vocabulary)
    while True:
        far = F.length("text") >= DEAL
        chunks = left.where(~far).mapInArrow(_cut_batches(overlap), CHUNKS)
        n = left.where(far).agg(F.sum(F.ceil(F.length("text") / CHUNK))).first()[0]
        if n:  # a number, as a chunk is few bytes with much work behind them
            dealt = left.where(far).mapInArrow(_cut_batches(overlap), CHUNKS)
            chunks = chunks.unionByName(dealt.repartition(-(-n // DEALT), "uid", "piece"))
        counted = materialise(splice(chunks.mapInArrow(_encode_batches(vocabulary, overlap, ranked), ENCODED)))
        good = counted.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = counted.where("n_tokens is null").select("uid")
        if failed.isEmpty():
            return done
        left = left.join(failed, "uid", "left_semi")
        overlap *= WIDEN  # after a few times the overlap is longer than any text


def count_documents(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 512, huge: int = HUGE) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Counts are those of the library over the whole text, without added special tokens; special strings inside a
    text are handled as the library's default does. Null counts as empty: no bytes, no tokens. Nulls and repeats
    in doc_id are rows like others; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    short = F.coalesce(F.length("text"), F.lit(0)) < huge
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    plain = rows.where(short).mapInArrow(_count_batches(vocabulary, by_rank(vocabulary)), f"doc_id {doc_type}, n_bytes long, n_tokens long")
    long = materialise(rows.where(~short).withColumn("uid", F.monotonically_increasing_id()))
    spliced = long.select("uid", "doc_id", "n_bytes").join(count_huge(long.select("uid", "text"), vocabulary), "uid").select("doc_id", "n_bytes", "n_tokens")
    return plain.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
