"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master; a cluster has no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "shoalwork-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    The committed files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder by its path in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, and lets go of shuffle files that nothing refers to any more.

    For tables that no later plan reads; Spark drops shuffle files when the driver collects its garbage.
    """
    for table in tables:
        delete(spark, table._table_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
