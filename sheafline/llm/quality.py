"""Quality selection by ordinal cumulative-link regression on graded ratings.

Ratings have three grades: 0 poor, 1 well written but toxic, 2 good. One set of weights over hashed text features
gives a score s, and ordered thresholds turn it into grades: P(grade <= k) = 1 / (1 + exp(s - t_k)). A document's
expected grade and its tail probability P(grade = 2) come from the same score; the tail probability selects.

The model is fitted on at most ``SAMPLE`` labelled rows, those of the smallest hash of doc_id. Features are counted by
grade in Spark; the driver gets a count for each feature and grade, picks at most ``STRONG`` features that tell grades
apart, and gets which rows have those: a table of a fixed size, however long the texts are. A document is scored where
it is read, by a broadcast of ``2 ** BITS`` weights. No document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .decontam import _portions, words_of

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_384
#: Hashed features: 2 to this power.
BITS = 18
GRADES = 3
#: Shares of the text's characters that are counted, by pattern, each cut into STEPS steps.
SHARES = ("[A-Z]", r"[^\pL\pN\s]", r"\pN", r"\n", r"[|#$%&*!]")
STEPS = 24
#: First letters of words that are features too, so that a stem counts whatever ends it has.
PREFIXES = (4, 5)
KEEP = 0.7
#: Standard errors from which a feature takes part, and features that do at most: with SAMPLE rows, 64 MB on the driver.
SCREEN = 10.0
STRONG = 1_024


def features(texts: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature of every text, each once: its words, their first letters, and the steps of its shares.

    With ``weights``, only those features that have a weight.
    """
    texts = pc.fill_null(texts, "")
    codes, names, starts = words_of(texts)
    size = max(1, len(names))
    pair = np.repeat(np.arange(len(texts)), np.diff(starts)) * size + codes
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    row, codes = pair // size, pair % size  # the distinct words of each text
    distinct = np.bincount(row, minlength=len(texts))
    shape = (1 << BITS) - (len(SHARES) + 3) * STEPS
    found = []
    for most in (None, *PREFIXES):
        hashed = np.array([xxhash.xxh64_intdigest(f"{most}:{w[:most]}") % shape for w in names], np.int64)
        own, at = row, codes
        if weights is not None and len(names):
            some = (weights[hashed] != 0)[codes]
            own, at = row[some], codes[some]
        found.append(np.unique((own << BITS) | hashed[at]) if len(at) else np.zeros(0, np.int64))
    key = np.unique(np.concatenate(found))
    n, chars = np.diff(starts), np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    measures = [np.sqrt(pc.count_substring_regex(texts, p).to_numpy(zero_copy_only=False) / chars) * STEPS for p in SHARES]
    measures += [distinct / np.maximum(n, 1) * STEPS, chars / np.maximum(n, 1) * 2, np.log2(n + 1)]
    steps = [shape + k * STEPS + np.clip(m, 0, STEPS - 1).astype(np.int64) for k, m in enumerate(measures)]
    return np.concatenate([key >> BITS, np.tile(np.arange(len(texts)), len(steps))]), np.concatenate([key & ((1 << BITS) - 1), *steps])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of the features, and the ordered thresholds between grades. Without any labels, all documents are good."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, -40.0))

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, code = features(texts, self.weights)
        return np.bincount(row, self.weights[code], minlength=len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... as columns."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _residuals(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of each row's negative log-likelihood, by its score and by the thresholds above and below its grade."""
    upper, lower = _sigmoid(cuts[grade + 1] - score), _sigmoid(cuts[grade] - score)
    # P(grade) = upper (1 - lower) gap; written so that nothing cancels where both are near 0 or 1
    gap = -np.expm1(-np.minimum(cuts[grade + 1] - cuts[grade], 700))
    return 1 - upper - lower, -(1 - upper) / (np.maximum(1 - lower, 1e-15) * gap), lower / (np.maximum(upper, 1e-15) * gap)


def strong(counts: np.ndarray, grades: np.ndarray, screen: float = SCREEN) -> np.ndarray:
    """The features that take part, in ascending order. counts: rows of each grade that have each feature; grades: rows of each grade.

    A feature takes part if its score test against the model without weights exceeds ``screen`` standard errors, so
    that rare words of no account don't fit the noise; of more than STRONG such features those of the largest tests.
    """
    if not grades.sum():
        return np.zeros(0, np.int64)
    null = _residuals(np.zeros(GRADES), np.arange(GRADES), np.concatenate(([-np.inf], _start(grades), [np.inf])))[0]
    null = null - (null * grades).sum() / grades.sum()
    variance = (null**2 * grades).sum() / grades.sum()
    rows = counts.sum(1)
    z = np.abs(counts @ null) / np.sqrt(np.maximum(rows, 1) * max(variance, 1e-12))
    found = np.flatnonzero((z >= screen) & (rows >= 3))
    return np.sort(found[np.argsort(-z[found], kind="stable")[:STRONG]])


def _start(grades: np.ndarray) -> np.ndarray:
    """Thresholds of the model without weights."""
    share = np.clip(np.cumsum(grades)[:-1] / grades.sum(), 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def fit(row: np.ndarray, code: np.ndarray, grade: np.ndarray, steps: int = 1000, rate: float = 0.3, shrink: float = 1e-5, screen: float = SCREEN) -> Model:
    """Cumulative-link regression by Adam over all rows at once, with shrunk weights. The thresholds are t_0 and t_0 + exp(d), in order."""
    if not len(grade):
        return Model()
    n, each = len(grade), np.arange(len(grade))
    grades = np.bincount(grade, minlength=GRADES)
    first = _start(grades)
    counts = np.stack([np.bincount(code[grade[row] == g], minlength=1 << BITS) for g in range(GRADES)], 1)
    used = strong(counts, grades, screen)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    has = np.zeros((n, len(used)), np.float32)
    held = place[code] >= 0
    has[row[held], place[code[held]]] = 1
    theta = np.concatenate([np.zeros(len(used)), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, t = theta[: len(used)], theta[len(used) :]
        cuts = np.concatenate(([-np.inf], t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:])))), [np.inf]))
        by_score, by_upper, by_lower = _residuals((has @ w.astype(np.float32)).astype(float), grade, cuts)
        by_cut = np.zeros((n, GRADES + 1))
        by_cut[each, grade + 1] += by_upper / n
        by_cut[each, grade] += by_lower / n
        by_cut = by_cut.sum(0)[1:-1]
        dt = [by_cut.sum(), *(by_cut[j:].sum() * np.exp(t[j]) for j in range(1, GRADES - 1))]
        g = np.concatenate([((by_score / n).astype(np.float32) @ has).astype(float) + shrink * w, dt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
    weights = np.zeros(1 << BITS)
    weights[used] = theta[: len(used)]
    t = theta[len(used) :]
    return Model(weights, t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:])))))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of ``labels(doc_id, quality, toxic)``: 0 poor, 1 toxic, 2 good; of repeats the lowest grade.

    Rows without doc_id or quality are no ratings; a toxic of null counts as not toxic.
    """
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled rows of ``docs(doc_id, text)``."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _portions(batch["text"]):
                row, code = features(batch["text"].slice(a, b - a))
                order = np.argsort(row, kind="stable")
                marks = np.searchsorted(row[order], np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(code[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["grade"].slice(a, b - a), lists], ["doc_id", "grade", "codes"])

    # repeated doc_ids could be more rows than labels: one row each
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "grade").mapInArrow(run, "doc_id long, grade int, codes array<int>")
    found = materialise(found.groupBy("doc_id").agg(F.min(F.struct("grade", "codes")).alias("r")).select("doc_id", "r.grade", "r.codes"))
    grades = np.zeros(GRADES, np.int64)
    for r in found.groupBy("grade").count().collect():
        grades[r["grade"]] = r["count"]
    tally = found.select("grade", F.explode("codes").alias("code")).groupBy("code").agg(*[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)]).toArrow()
    counts = np.zeros((1 << BITS, GRADES), np.int64)  # as many rows as there are features, at most
    counts[tally["code"].to_numpy()] = np.stack([tally[f"g{g}"].to_numpy() for g in range(GRADES)], 1)
    chosen = strong(counts, grades)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["codes"]
            code, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            good = np.isin(code, chosen)
            row = np.repeat(np.arange(len(lengths)), lengths)[good]
            marks = np.searchsorted(row, np.arange(len(lengths) + 1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(code[good], pa.int32()))], ["doc_id", "grade", "codes"])

    table = found.mapInArrow(keep, found.schema).orderBy("doc_id").toArrow()
    lengths = pc.list_value_length(table["codes"]).to_numpy()
    code = table["codes"].combine_chunks().flatten().to_numpy()
    return fit(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), code, table["grade"].to_numpy().astype(np.int64))


GRADED = "doc_id long, expected_grade double, p_good double, kept boolean"


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, expected_grade, p_good = P(grade = 2), kept = p_good >= keep.

    Null counts as empty. Rows that repeat, or have no doc_id, are scored each; other columns are ignored; an empty
    table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _portions(batch["text"]):
                tails = sent.value.tails(sent.value.scores(batch["text"].slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)], ["doc_id", "expected_grade", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, GRADED)


def drop_rejected(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _portions(batch["text"]):
                good = sent.value.tails(sent.value.scores(batch["text"].slice(a, b - a)))[:, -1] >= keep
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
