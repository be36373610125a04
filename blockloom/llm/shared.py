"""Helpers that several corpus operators use: shared storage, cheap text views, Arrow output."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Only where a local session names none (as in tests), a temporary folder is set; on a cluster that
    is an error, as executors would not see the driver's folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage is cut and no later stage works it out again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kth_smallest(df: DataFrame, column: str, k: int):
    """The k-th smallest value of a column, the largest where there are fewer, None where there are none.

    Filtering by it takes k rows without moving them into one task: only k values of each task are merged.
    """
    return df.select(column).orderBy(column).limit(k).agg(F.max(column)).first()[0]


def text_or_empty(column: str):
    """The text column as string, null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def large_strings(array: pa.Array) -> list[str]:
    """The values of a string column with nulls read as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
