"""Reading tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; ``sf_dir`` is any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that would be a
    folder of one machine only, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/sheafline-{os.getpid()}"
    return f"{base.rstrip('/')}/sheafline-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later reads survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
