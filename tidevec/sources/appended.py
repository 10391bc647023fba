"""The vector table that a stream appends to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidevec.schemas import VECTORS
from tidevec.sources.shared import exists


def appended(spark: SparkSession, path: str) -> DataFrame:
    """slot, id, vec of all that has been appended at path so far."""
    if not exists(spark, path):
        return spark.createDataFrame([], VECTORS)
    return spark.read.schema(VECTORS + ", batch BIGINT").option("basePath", path).parquet(path).select("slot", "id", "vec")
