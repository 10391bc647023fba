"""The folder that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, on one machine else a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", "tidevec")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def in_folder(spark: SparkSession, use: Callable[[str], DataFrame]) -> DataFrame:
    """What use(path) gives for a new folder, checkpointed, after which the folder is deleted."""
    path = f"{shared_dir(spark)}/tidevec-{uuid.uuid4()}"
    try:
        return use(path).checkpoint(eager=True)
    finally:
        delete(spark, path)
