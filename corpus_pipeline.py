"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafline.llm import decontam, exact_dedup, packing, quality, simhash
from sheafline.llm.common import materialise, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on labelled rows of the stage's own input."""
    return quality.drop_rejected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Items of fewer than 5 words are in documents by chance."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), least=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL: the classifier, the packing and the tokenizer can't be expressed in it. tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
