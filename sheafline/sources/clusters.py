"""The vector table by clusters: Parquet partitioned by namespace and cluster, searched exactly without reading all of it.

Each vector belongs to the centroid that is nearest by angle; of each cluster of a namespace the table keeps the number
of its vectors and its radius, the widest angle to the centroid. By the triangle inequality of angles no vector of a
cluster is nearer to a query than the angle to the centroid less the radius. A search reads the clusters that are likely
best, which gives each query a running k-th score, and then those clusters alone whose bound reaches that score. So the
result is that of comparing everything, and files of other clusters are not opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.operators.retrieval import BLOCK
from sheafline.stored import stored

#: Vectors that centroids are fitted on, at most, and bytes that these come to; the vectors with the least hashes of their id.
SAMPLE, SAMPLE_BYTES = 16_384, 67_108_864
#: Centroids, at most; there are as many as the square root of the number of vectors.
CENTROIDS = 1_024
TURNS = 10
#: Vectors of a file of a cluster.
FILE_ROWS = 262_144
#: Clusters that a query reads first: until they have so many times k vectors.
FIRST = 4
#: What rounding may add to a cosine.
SLACK = 1e-9
#: The cluster of vectors without direction: their cosine counts as 0.
NONE = -1


@dataclass(frozen=True)
class Table:
    """A stored table: its folder, the centroids, and a row (namespace, cluster, n, radius) of each cluster."""

    path: str
    centroids: np.ndarray
    clusters: list[tuple[str | None, int, int, float]]


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fit(chunks: DataFrame, most: int = CENTROIDS, seed: int = 7) -> np.ndarray:
    """Centroids of a sample that is bounded by SAMPLE and SAMPLE_BYTES, by spherical k-means; none for a table without vectors."""
    held = chunks.where("vector is not null")
    first = held.select(F.size("vector")).first()
    if first is None:
        return np.zeros((0, 0))
    rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, first[0]))))
    order = F.xxhash64(F.col("chunk_id").cast("string"))
    sample = unit(np.array([r["vector"] for r in held.select("vector", order.alias("h")).orderBy("h", "vector").limit(rows).collect()], float))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    k = int(min(most, len(sample), max(1, round(held.count() ** 0.5))))
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:k]]
    for _ in range(TURNS if k else 0):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(filled[:, None], unit(sums), centroids)
    return centroids


def write(chunks: DataFrame, path: str, centroids: np.ndarray | None = None) -> Table:
    """Stores ``chunks(chunk_id, namespace, vector, ...)`` at ``path`` and returns its table.

    Rows without a vector are left out; vectors of zeros are a cluster of their own. Clusters are written by as many tasks
    as they need for files of FILE_ROWS, so one that holds a third of all rows is many files.
    """
    spark = chunks.sparkSession
    centroids = fit(chunks) if centroids is None else centroids
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                vectors = unit(np.array(part["vector"].to_pylist(), float))
                cosines = vectors @ sent.value.T
                nearest = cosines.argmax(1) if cosines.shape[1] else np.zeros(len(vectors), np.int64)
                angle = _angles(cosines[np.arange(len(vectors)), nearest]) if cosines.shape[1] else np.zeros(len(vectors))
                none = np.linalg.norm(vectors, axis=1) == 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(none, NONE, nearest).astype(np.int32)), pa.array(np.where(none, 0, angle))], [*part.schema.names, "cluster", "angle"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    held = chunks.where("vector is not null")
    assigned = stored(held.mapInArrow(assign, StructType(list(held.schema.fields)).add("cluster", IntegerType()).add("angle", DoubleType())))
    clusters = assigned.groupBy("namespace", "cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    clusters = stored(clusters.withColumn("files", F.ceil(F.col("n") / FILE_ROWS)))
    salted = assigned.join(F.broadcast(clusters.select("namespace", "cluster", "files").withColumnRenamed("namespace", "__n").withColumnRenamed("cluster", "__c")), F.col("namespace").eqNullSafe(F.col("__n")) & (F.col("cluster") == F.col("__c")))
    salted = salted.withColumn("__file", F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.col("files"))).repartition("namespace", "cluster", "__file")
    salted.drop("__n", "__c", "files", "__file").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("namespace", "cluster").parquet(path)
    return Table(path, centroids, [(r["namespace"], r["cluster"], r["n"], r["radius"]) for r in clusters.orderBy("namespace", "cluster").collect()])


def bounds(table: Table, queries: np.ndarray) -> np.ndarray:
    """The highest cosine that a vector of each cluster can have with each query: queries x clusters."""
    which = np.array([c for _, c, _, _ in table.clusters], np.int64)
    radius = np.array([r for *_, r in table.clusters])
    none = np.linalg.norm(queries, axis=1) == 0
    out = np.zeros((len(queries), len(which)))
    real = which != NONE
    if real.any():
        nearest = _angles(queries @ table.centroids.T)[:, which[real]] - radius[real]
        out[:, real] = np.cos(np.clip(nearest, 0, np.pi)) + SLACK
    out[none] = 0
    return out


HITS = "query_id long, chunk_id long, score double"


def _read(spark: SparkSession, table: Table, asked: tuple, wanted: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` of each query out of the clusters that it wants: a task's rows meet only the queries that ask for them."""
    ids, vectors = asked
    lists = {(n, c): np.flatnonzero(wanted[:, i]) for i, (n, c, _, _) in enumerate(table.clusters) if wanted[:, i].any()}
    held = spark.read.parquet(table.path)
    spaces = sorted({n for n, _ in lists if n is not None})
    some = F.col("namespace").cast("string").isin(*spaces) | (F.col("namespace").isNull() if any(n is None for n, _ in lists) else F.lit(False))
    held = held.where(some & F.col("cluster").isin(*sorted({c for _, c in lists})))
    sent = spark.sparkContext.broadcast((ids, vectors, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, lists = sent.value
        top = {}
        for batch in batches:
            names, clusters = batch["namespace"].to_pylist(), batch["cluster"].to_numpy()
            change = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or clusters[i] != clusters[i - 1]), len(names)]
            for a, b in zip(change, change[1:], strict=False):
                mine = lists.get((names[a], int(clusters[a]))) if b > a else None
                if mine is None:
                    continue
                for i in range(a, b, 2048):
                    part = batch.slice(i, min(2048, b - i))
                    chunk = part["chunk_id"].to_numpy()
                    scores = unit(np.array(part["vector"].to_pylist(), float)) @ vectors[mine].T
                    for j, q in enumerate(mine.tolist()):
                        s, c = top.get(q, (np.zeros(0), np.zeros(0, np.int64)))
                        own = scores[:, j] if len(s) < k else scores[scores[:, j] >= s[-1], j]
                        if len(own):
                            s, c = np.concatenate((s, own)), np.concatenate((c, chunk if len(own) == len(chunk) else chunk[scores[:, j] >= s[-1]]))
                            best = np.lexsort((c, -s))[:k]
                            top[q] = s[best], c[best]
        for q, (s, c) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[q], np.int64)), pa.array(c), pa.array(s)], ["query_id", "chunk_id", "score"])

    rows = held.select("chunk_id", F.col("namespace").cast("string").alias("namespace"), F.col("cluster").cast("int").alias("cluster"), "vector").mapInArrow(run, HITS)
    return rows


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, table: Table, k: int, scope: str = "any", common: str = "global", stats: list | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` vectors nearest by cosine to each of ``queries(query_id, namespace, vector)``, ties by chunk_id.

    ``scope``: ``any``, ``target`` (the query's own namespace) or ``both`` (that and ``common``). Queries are sent in blocks;
    the driver holds a block's vectors and the bounds of all clusters for it. ``stats`` gets, for each block, the vectors
    that were read, those of the table, and the compared pairs as a share of all. A query without a vector finds nothing.
    """
    spark, out = queries.sparkSession, None
    sizes = np.array([n for _, _, n, _ in table.clusters], np.int64)
    held = queries.where("vector is not null")
    blocks = max(1, -(-held.count() // BLOCK))
    for block in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "namespace", "vector").orderBy("query_id").collect()
        if not rows or not len(sizes):
            continue
        ids, vectors = np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["vector"] for r in rows], float))
        most = bounds(table, vectors)
        for i, r in enumerate(rows):
            if scope != "any":
                most[i, [n != r["namespace"] and not (scope == "both" and n == common) for n, *_ in table.clusters]] = -np.inf
        order = np.argsort(-most, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(most.shape, bool)
        np.put_along_axis(first, order, before < FIRST * k, axis=1)
        first &= most > -np.inf
        begun = stored(_ranked(_read(spark, table, (ids, vectors), first, k), k))
        kth = {r["query_id"]: r["s"] for r in begun.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        reached = np.array([kth.get(i, -np.inf) for i in ids.tolist()]) - SLACK
        rest = ~first & (most > -np.inf) & (most >= reached[:, None])
        found = begun.drop("rank")
        if rest.any():
            found = found.unionByName(_read(spark, table, (ids, vectors), rest, k))
        if stats is not None:
            stats.append((int(sizes[(first | rest).any(0)].sum()), int(sizes.sum()), float(((first | rest) * sizes).sum() / max(1, sizes.sum() * len(ids)))))
        found = _ranked(found, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return out.select("query_id", "chunk_id", "score", "rank")
