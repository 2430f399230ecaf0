"""The folder that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder, and a cluster, whose nodes would each write their own, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="candrank-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


ROWS_A_TASK = 250_000


def dealt(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df hashed by keys into a task for each ROWS_A_TASK of its n rows, so that a task's memory is the same at any size.

    What is grouped, joined or ranked by the keys (or the keys and more columns) afterwards needs no other shuffle.
    The number is asked for, so that adaptive execution does not merge small parts into a few large ones.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_TASK)), *keys)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder once and read back: what several jobs read is computed once, and its lineage ends."""
    at = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
