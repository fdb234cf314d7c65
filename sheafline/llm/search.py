"""Ranked lexical search over an index that is sharded by documents.

A shard holds the postings of up to ``SHARD_DOCS`` documents in compressed sparse rows: its terms in byte order, where
each term's postings begin, and for each posting the document's place in the shard and an integer impact. The impact
is the posting's whole share of a score but for the term's weight; it needs only the number of documents and of terms,
which a first pass counts. So an index doesn't depend on the queries, and building it shuffles nothing.

Queries are searched term at a time: a shard's dense accumulator gets weight x impact of each of the query's terms;
``argpartition`` finds the k-th score, and among documents of just that score the smallest doc_ids are taken. Tasks
keep a running best of each query over their shards, and those are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Documents and postings at which a shard is closed, and bytes of text that are cut into terms at once.
SHARD_DOCS = 65_536
SHARD_POSTINGS = 2_097_152
PIECE = 4_194_304
#: Queries and terms of queries that are searched at once; more queries read the index again.
QUERIES = 1_024
QUERY_TERMS = 262_144
#: Parts in which the best of the tasks are merged first.
MERGE = 32
K = 50

# Fixed value: the characters of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: By byte of UTF-8: whether it belongs to a term (every byte from 0x80 on does), and the byte in lower case.
IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where each part begins and the end, the document of each part): PIECE bytes at once, cut between terms."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        at, end = int(offsets[a]), int(offsets[b])
        if end - at <= PIECE:
            yield data[at:end], offsets[a : b + 1] - at, np.arange(a, b)
        else:  # one long text
            while at < end:
                stop = at + PIECE
                while stop < end:
                    gap = np.flatnonzero(~IN_TERM[data[stop : stop + PIECE]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop += PIECE
                stop = min(stop, end)
                yield data[at:stop], np.array([0, stop - at]), np.array([a])
                at = stop
        a = b


def _spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to terms, where terms begin, and the number of terms of each part."""
    inside = IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    return inside, starts, np.diff(np.searchsorted(starts, bounds))


def term_counts(texts: pa.Array) -> np.ndarray:
    """Terms of each text, repeats included; none in a null."""
    out = np.zeros(len(texts), np.int64)
    for data, bounds, docs in _pieces(texts):
        np.add.at(out, docs, _spans(data, bounds)[2])
    return out


def _postings(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a piece, and for each pair of a term and a document: the term's place among them, the document, occurrences."""
    inside, starts, n = _spans(data, bounds)
    # a term's bytes without those between terms: the next term begins where it ends
    kept = np.cumsum(inside) - inside
    offsets = np.append(kept[starts], inside.sum()).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[inside]])])
    coded = terms.dictionary_encode()
    part = np.repeat(np.arange(len(docs)), n)
    keys, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + part, return_counts=True)
    return coded.dictionary, keys // len(docs), docs[keys % len(docs)], times


def _m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length against the mean; whole numbers beyond 64 bits where they are needed."""
    wide = 50 * n_docs * int(n.max(initial=0)) >= 2**63
    return (50 + 50 * n.astype(object if wide else np.int64) * n_docs // n_terms).astype(np.int64)


SHARD = "n_docs int, doc_ids binary, known binary, terms binary, term_at binary, begins binary, docs binary, impacts binary"


class _Shard:
    """The documents and pieces that a shard will hold."""

    def __init__(self):
        self.ids, self.n, self.pieces, self.n_docs, self.n_postings = [], [], [], 0, 0

    def add(self, ids: pa.Array, n: np.ndarray, pieces: list[tuple]) -> None:
        self.pieces += [(terms, code, doc + self.n_docs, times) for terms, code, doc, times in pieces]
        self.ids.append(ids)
        self.n.append(n)
        self.n_docs += len(ids)
        self.n_postings += sum(len(p[1]) for p in pieces)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids, n = pa.chunked_array(self.ids).combine_chunks(), np.concatenate(self.n)
        joint = pa.chunked_array([p[0] for p in self.pieces], pa.large_binary()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(joint.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes, skip, keys = joint.indices.to_numpy(), 0, []
        for terms, code, doc, _ in self.pieces:
            keys.append(place[codes[skip : skip + len(terms)]][code] * self.n_docs + doc)
            skip += len(terms)
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        by = np.argsort(keys, kind="stable")
        keys, times = keys[by], np.concatenate([*(p[3] for p in self.pieces), np.zeros(0, np.int64)])[by]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, times = keys[new], np.add.reduceat(times, new) if len(new) else times  # parts of a long text have terms in common
        doc = keys % self.n_docs
        impacts = 1_000_000_000 * times // (1000 * times + 20 * _m(n, n_docs, n_terms)[doc]) if len(keys) else times
        terms = joint.dictionary.take(pa.array(order))
        sizes = pc.binary_length(terms).to_numpy() if len(terms) else np.zeros(0, np.int64)
        values = [
            self.n_docs,
            pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes(),
            np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes(),
            b"".join(terms.to_pylist()),
            np.concatenate(([0], np.cumsum(sizes))).astype("<i8").tobytes(),
            np.searchsorted(keys // self.n_docs, np.arange(len(terms) + 1)).astype("<i8").tobytes(),
            doc.astype("<u2").tobytes(),
            impacts.astype("<u4").tobytes(),
        ]
        kinds = [pa.int32()] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split(" ")[0] for c in SHARD.split(", ")])


def _index_batches(n_docs: int, n_terms: int, most_docs: int, most_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                # documents that come to a piece of text, or one document
                sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"].slice(a)), 0).to_numpy())
                b = a + min(max(1, int(np.searchsorted(sizes, PIECE, "right"))), most_docs)
                texts = batch["text"].slice(a, b - a)
                pieces = [_postings(*piece) for piece in _pieces(texts)]
                n = np.zeros(b - a, np.int64)
                for _, _, doc, times in pieces:
                    np.add.at(n, doc, times)
                if shard.n_docs and shard.n_docs + b - a > most_docs:
                    yield shard.row(n_docs, n_terms)
                    shard = _Shard()
                shard.add(batch["doc_id"].slice(a, b - a), n, pieces)
                if shard.n_postings >= most_postings:
                    yield shard.row(n_docs, n_terms)
                    shard = _Shard()
                a = b
        if shard.n_docs:
            yield shard.row(n_docs, n_terms)

    return run


def _total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        n = term_counts(batch["text"])
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents."""
    found = docs.select("text").mapInArrow(_total_batches, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, n_docs: int, n_terms: int, most_docs: int = SHARD_DOCS, most_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The stored shards of ``docs(doc_id, text)``, a row each. Every document is in one; tasks build them from their own rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(_index_batches(n_docs, n_terms, min(most_docs, SHARD_DOCS), most_postings), SHARD))


def _terms_of(row: dict) -> pa.Array:
    at = np.frombuffer(row["term_at"], "<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(row["term_at"]), pa.py_buffer(row["terms"])])


def _held(row: dict, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the wanted terms that a shard has, and where the postings of each begin and end."""
    found = pc.index_in(_terms_of(row), value_set=wanted)
    has = found.is_valid().to_numpy(zero_copy_only=False)
    begins = np.frombuffer(row["begins"], "<i8")
    return found.filter(pa.array(has)).to_numpy(), begins[:-1][has], begins[1:][has]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def document_counts(index: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """Documents that hold each of the wanted terms. Only the shards' terms are read; the driver gets a number for each term."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(sent.value, pa.large_binary())
        out = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                which, a, b = _held(row, terms)
                out[which] += b - a
        which = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(out[which])], ["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms", "term_at", "begins").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; of equal ones those of the smallest known id, unknown ids last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
        more, ties = at[own > least], at[own == least]
        ties = ties[np.lexsort((ids[ties], ~known[ties]))[: k - len(more)]]
        at = np.concatenate((more, ties))
    return at[np.lexsort((ids[at], ~known[at], -scores[at]))]


FOUND = "query long, doc_id long, score long, part int"


def _search_batches(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, queries = sent.value
        wanted = pa.array(wanted, pa.large_binary())
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        top, part = [empty] * len(queries), None
        for batch in batches:
            part = batch["part"][0].as_py() if part is None and batch.num_rows else part
            for row in _rows(batch):
                ids, n = np.frombuffer(row["doc_ids"], "<i8"), row["n_docs"]
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool)
                docs, impacts = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["impacts"], "<u4")
                at = {t: (a, b) for t, a, b in zip(*(x.tolist() for x in _held(row, wanted)), strict=True)}
                total = np.zeros(n, np.int64)
                for q, (_, terms) in enumerate(queries):
                    held = [t for t in terms if t in at]
                    if not held:
                        continue
                    total[:] = 0
                    for t in held:  # a document has one posting of a term at most
                        a, b = at[t]
                        total[docs[a:b]] += weights[t] * impacts[a:b].astype(np.int64)
                    found = best(total, ids, known, k)
                    joint = [np.concatenate(x) for x in zip(top[q], (total[found], ids[found], known[found]), strict=True)]
                    kept = best(*joint, k)
                    top[q] = tuple(x[kept] for x in joint)
        for (query, _), (scores, ids, known) in zip(queries, top, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(scores), pa.int64()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores), pa.array([part] * len(scores), pa.int32())], ["query", "doc_id", "score", "part"])

    return run


def query_terms(queries: DataFrame) -> DataFrame:
    """``query, item_id, terms`` of ``queries(item_id, text)``: the distinct terms of each row's whole text; rows without any are left out."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(TERM), 0))
    return queries.select(F.monotonically_increasing_id().alias("query"), "item_id", terms.alias("terms")).where("size(terms) > 0")


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of the index for each row of ``queries(item_id, text)``.

    Queries are searched in blocks of about QUERIES rows and QUERY_TERMS terms, which the driver sends to the tasks.
    """
    asked = materialise(query_terms(queries))
    n, terms = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // QUERIES), -(-(terms or 0) // QUERY_TERMS))
    shards, out = index.withColumn("part", F.spark_partition_id()), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "terms").orderBy("query").collect()
        wanted = sorted({t.encode() for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(wanted)}
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in document_counts(index, wanted).tolist()]
        sent = index.sparkSession.sparkContext.broadcast((wanted, weights, [(r["query"], [place[t.encode()] for t in r["terms"]]) for r in rows]))
        found = shards.mapInArrow(_search_batches(sent, k), FOUND)
        out = found if out is None else out.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod("part", F.lit(MERGE))
    merged = out.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return merged.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs(doc_id, text)`` for each row of ``queries(item_id, text)``, scores above 0 only.

    Equal scores rank by ascending doc_id, rows without doc_id last. Rows that repeat a doc_id are documents each, rows
    that repeat an item_id queries each. Null and empty texts have no terms: as documents they count for nothing, as
    queries they get no rows. Terms of any length and texts of any length are read whole. Other columns are ignored;
    empty tables give an empty table.
    """
    n_docs, n_terms = totals(docs)
    return search(build_index(docs, n_docs, max(1, n_terms)), n_docs, queries, k)
