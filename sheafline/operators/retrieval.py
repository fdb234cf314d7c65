"""Top-k retrieval of chunks for a stated set of queries: lexical, vector and layered.

Queries are few and are sent to the tasks in blocks of a bounded size; every task scores its own chunks for the
whole block and keeps the best of each query and layer, so what is shuffled is ``k`` rows for each query, layer and
batch, never the product of queries and chunks. The last ranking is a window over these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

#: Queries that are sent at once.
BLOCK = 4096


@dataclass(frozen=True)
class Layer:
    """One step of a retrieval plan. ``scope``: ``target``, ``global`` or ``any``; empty tuples allow everything."""

    name: str
    scope: str = "any"
    layers: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    top_k: int = 10


@dataclass(frozen=True)
class Plan:
    """What a query asks of each chunk. ``bonus`` is added where the namespace is the query's; ``least`` is a bound that scores must exceed."""

    layers: tuple[Layer, ...] = (Layer("all"),)
    bonus: float = 0.0
    least: float | None = 0.0
    global_namespace: str = "global"
    boost: bool = False
    extra: dict = field(default_factory=dict)


HITS = "query_id long, layer int, chunk_id long, score double"


def fixed_chunks(docs: DataFrame, size: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``size`` characters; an empty or null text is one empty piece. Adds ``part`` and ``chunk_text``.

    One pass cuts a text, and rows of pieces don't carry it.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{int(size)}}}+"), F.lit(0))
    return docs.select(id_column, F.posexplode(F.when(F.length(text) > 0, cut).otherwise(F.array(F.lit("")))).alias("part", "chunk_text"))


class _Matcher:
    """For each text, how many tokens of each query it contains; one pass over the text for all of them."""

    def __init__(self, queries: list[tuple[int, list[str]]]):
        import ahocorasick

        self.n, of = len(queries), {}
        for i, (_, tokens) in enumerate(queries):
            for t in tokens:
                row = of.setdefault(t, {})
                row[i] = row.get(i, 0) + 1
        self.counts = [(np.fromiter(r, int, len(r)), np.fromiter(r.values(), float, len(r))) for r in of.values()]
        self.machine = ahocorasick.Automaton()
        for k, t in enumerate(of):
            self.machine.add_word(t, k)
        if of:
            self.machine.make_automaton()

    def scores(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.n)
        if text and self.counts:
            for k in {k for _, k in self.machine.iter(text)}:
                at, n = self.counts[k]
                out[at] += n
        return out


def _best(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, least: float | None, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of its best ``k`` chunks): by score, then by id. score: chunks x queries."""
    for q in range(score.shape[1]):
        s = score[:, q]
        good = np.flatnonzero(allowed[:, q] & (s > least if least is not None else True))
        if len(good):
            yield q, good[np.lexsort((ids[good], -s[good]))[:k]]


def _hits(score: np.ndarray, batch: pa.RecordBatch, query_ids: np.ndarray, targets: list[str], plan: Plan) -> pa.RecordBatch:
    ids = batch["chunk_id"].to_numpy(zero_copy_only=False)
    names = np.array(batch["namespace"].to_pylist(), object)
    layers, types = np.array(batch["corpus_layer"].to_pylist(), object), np.array(batch["source_type"].to_pylist(), object)
    own = names[:, None] == np.array(targets, object)[None, :]
    if plan.bonus:
        score = score + plan.bonus * own
    if plan.boost:
        score = score * np.array([b or 1.0 for b in batch["rank_boost"].to_pylist()])[:, None]
    rows: list[tuple[np.ndarray, ...]] = []
    for number, layer in enumerate(plan.layers):
        fits = np.ones(len(ids), bool)
        if layer.layers:
            fits &= np.isin(layers.astype(str), layer.layers)
        if layer.types:
            fits &= np.isin(types.astype(str), layer.types)
        scope = own if layer.scope == "target" else (names == plan.global_namespace)[:, None] & np.ones_like(own) if layer.scope == "global" else np.ones_like(own)
        for q, at in _best(score, ids, fits[:, None] & scope, plan.least, layer.top_k):
            rows.append((np.full(len(at), query_ids[q]), np.full(len(at), number), ids[at], score[at, q]))
    parts = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(p.astype(t.to_pandas_dtype())) for p, t in zip(parts, kinds, strict=True)], ["query_id", "layer", "chunk_id", "score"])


def _running(parts: Iterator[pa.RecordBatch], plan: Plan, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The best of each query and layer over all of a task's batches, so that a task yields no more than they are, however many chunks it reads."""
    held: list[pa.RecordBatch] = []
    top = np.array([layer.top_k for layer in plan.layers])

    def best() -> pa.RecordBatch:
        q, layer, chunk, score = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("query_id", "layer", "chunk_id", "score"))
        order = np.lexsort((chunk, -score, layer, q))
        q, layer, chunk, score = q[order], layer[order], chunk[order], score[order]
        first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (layer[1:] != layer[:-1]))) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        good = place < top[layer] if len(q) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(layer[good]), pa.array(chunk[good]), pa.array(score[good])], ["query_id", "layer", "chunk_id", "score"])

    grown = 0
    for part in parts:
        held.append(part)
        grown += part.num_rows
        if grown > most:
            held, grown = [best()], 0
    if held:
        yield best()


def _columns(chunks: DataFrame, payload: str) -> DataFrame:
    """The columns that scoring needs; those that a table doesn't have are null."""
    have = set(chunks.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    boost = F.col("rank_boost").cast("double") if "rank_boost" in have else F.lit(None).cast("double")
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col(payload), text("namespace").alias("namespace"), text("corpus_layer").alias("corpus_layer"), text("source_type").alias("source_type"), boost.alias("rank_boost"))


def _query_blocks(queries: DataFrame, columns: Sequence[str]) -> Iterator[list]:
    n = max(1, -(-queries.count() // BLOCK))
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).select(*columns).orderBy("query_id").collect()


def _final(partial: DataFrame, plan: Plan) -> DataFrame:
    """The best of each query and layer, each chunk in its first layer only, ranked over all layers."""
    top = F.create_map(*[F.lit(x) for i, layer in enumerate(plan.layers) for x in (i, layer.top_k)])
    in_layer = Window.partitionBy("query_id", "layer").orderBy(F.desc("score"), "chunk_id")
    kept = partial.withColumn("place", F.row_number().over(in_layer)).where(F.col("place") <= top[F.col("layer")])
    if len(plan.layers) > 1:
        kept = kept.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("layer", "place"))).where("seen = 1")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("layer", "place")))
    return ranked.select("query_id", "layer", "chunk_id", "score", "rank")


def lexical_topk(queries: DataFrame, chunks: DataFrame, plan: Plan) -> DataFrame:
    """``query_id, layer, chunk_id, score, rank`` for ``queries(query_id, query, namespace)`` over ``chunks(chunk_id, text, ...)``.

    The score counts the query's tokens that the lower-cased text contains, plus the plan's bonus.
    """
    rows, out = _columns(chunks.withColumn("text", F.lower("text")), "text"), None
    asked = queries.select("query_id", "namespace", T.lexical_tokens(F.col("query")).alias("tokens"))
    for block in _query_blocks(asked, ["query_id", "namespace", "tokens"]):
        sent = chunks.sparkSession.sparkContext.broadcast([(r["query_id"], r["namespace"], r["tokens"]) for r in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _Matcher([(q, t) for q, _, t in sent.value])
            ids, targets = np.array([q for q, _, _ in sent.value], np.int64), [n for _, n, _ in sent.value]
            parts = (batch.slice(i, 2048) for batch in batches for i in range(0, batch.num_rows, 2048))
            yield from _running((_hits(np.stack([matcher.scores(t) for t in part["text"].to_pylist()]), part, ids, targets, plan) for part in parts), plan)

        found = rows.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return _final(out, plan)


def flat_topk(queries: DataFrame, chunks: DataFrame, k: int, bonus: float = 2.0, global_namespace: str = "global") -> DataFrame:
    """``query_id, chunk_id, score, rank`` over target and global chunks in one ranking; target chunks get ``bonus``, so each of them qualifies."""
    plan = Plan(layers=(Layer("target", "target", top_k=k), Layer("global", "global", top_k=k)), bonus=bonus, global_namespace=global_namespace)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return lexical_topk(queries, chunks, plan).withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def vector_topk(queries: DataFrame, chunks: DataFrame, plan: Plan) -> DataFrame:
    """As ``lexical_topk``, by cosine similarity in double precision of ``queries.vector`` and ``chunks.vector``; a zero norm counts as 1."""
    rows, out = _columns(chunks, "vector"), None
    for block in _query_blocks(queries, ["query_id", "namespace", "vector"]):
        sent = chunks.sparkSession.sparkContext.broadcast([(r["query_id"], r["namespace"], r["vector"]) for r in block])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, targets = np.array([q for q, _, _ in sent.value], np.int64), [n for _, n, _ in sent.value]
            asked = np.array([v for _, _, v in sent.value], float)
            norm = np.linalg.norm(asked, axis=1) if len(asked) else np.zeros(0)

            def scored(part: pa.RecordBatch) -> pa.RecordBatch:
                held = np.array(part["vector"].to_pylist(), float)
                own = np.linalg.norm(held, axis=1)
                return _hits(held @ asked.T / (np.where(own > 0, own, 1)[:, None] * np.where(norm > 0, norm, 1)[None, :]), part, ids, targets, plan)

            if len(asked):
                yield from _running((scored(batch.slice(i, 1024)) for batch in batches for i in range(0, batch.num_rows, 1024)), plan)

        found = rows.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return _final(out, plan)


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, top_n: int, score=None) -> DataFrame:
    """The best ``top_n`` of each query's hits by a second score; ``score`` is a Column function of query and text, lexical by default."""
    scored = (score or T.lexical_score)(F.col("query"), F.col("text")).cast("double")
    joined = hits.join(texts.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return joined.withColumn("rerank_score", scored).withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= top_n).drop("text", "query")


def masked_query(namespace: str, *parts: str):
    """Retrieval text of a question: its namespace and its non-blank parts, never the held-out answer."""
    kept = [F.when(~T.blank(F.col(p)), T.collapse(F.col(p))) for p in parts]
    return F.concat_ws(" ", T.collapse(F.col(namespace)), *kept)
