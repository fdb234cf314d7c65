"""The vector table: chunks with embeddings, as Parquet partitioned by namespace."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import text as T


class Embedder(Protocol):
    """Vectors for texts; called in tasks with a batch at a time. Services sit behind this port."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder without a service: signed hashes of lower-cased words and character pairs, normalised."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            text = (text or "").lower()
            for part in (*text.split(), *(text[k : k + 2] for k in range(len(text) - 1))):
                h = xxhash.xxh64_intdigest(part)
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embedded(chunks: DataFrame, embedder: Embedder, text: str = "text_for_embedding", batch: int = 32) -> DataFrame:
    """``chunks`` with ``vector``. A batch whose vectors are fewer than its texts is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = np.asarray(embedder(part[text].to_pylist()), np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "vector"])

    from pyspark.sql.types import ArrayType, FloatType, StructType

    return chunks.mapInArrow(run, StructType(list(chunks.schema.fields)).add("vector", ArrayType(FloatType())))


def write(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stores embedded chunks with their point ids; files of a namespace are sorted by layer and type, so filters skip row groups."""
    named = chunks.withColumn("point_id", T.point_id(F.col("chunk_id").cast("string")))
    keys = [c for c in ("namespace", "corpus_layer", "source_type") if c in chunks.columns]
    # the chunk id is part of the range: a namespace of any size is spread over files
    named.repartitionByRange(*[F.col(k) for k in keys], F.col("chunk_id")).sortWithinPartitions(*keys).write.mode(mode).partitionBy("namespace").parquet(path)


def resume(chunks: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """The chunks that the stored table doesn't have yet."""
    return pending(chunks, spark.read.parquet(path), "chunk_id")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key ``done`` doesn't have; null keys are pending always."""
    return rows.join(done.select(key), key, "left_anti")
