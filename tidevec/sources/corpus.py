"""Corpus files: Parquet with one row for each step of a record; the vector is obs, its id episode_id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidevec.errors import CorpusError
from tidevec.schemas import CORPUS


def to_corpus(vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """vectors(slot, id, vec) as one record: run 1, sequence 0, seed 0, all that has no meaning here 0, mask 1."""
    zero = lambda kind: F.lit(0).cast(kind)
    return vectors.select(
        F.lit(1).cast("long").alias("run_id"), zero("long").alias("sequence"), zero("long").alias("seed"), F.col("slot").cast("int").alias("row"), F.col("id").alias("episode_id"),
        zero("long").alias("env_id"), zero("long").alias("step"), F.col("vec").alias("obs", metadata={"metric": metric}), zero("int").alias("action"), zero("float").alias("reward"), zero("int").alias("terminal"),
        F.array(F.lit(1)).alias("action_mask"), zero("float").alias("value"), zero("float").alias("logp"), F.array(F.lit(0)).alias("states"),
    )


def save(vectors: DataFrame, path: str, metric: str = "l2") -> None:
    to_corpus(vectors, metric).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A corpus; CorpusError if it is not there or has other columns."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise CorpusError(f"{path} cannot be read") from e
    missing = {f.split()[0] for f in CORPUS.split(", ")} - set(df.columns)
    if missing:
        raise CorpusError(f"{path} has no column {', '.join(sorted(missing))}")
    return df


def rows(spark: SparkSession, path: str) -> DataFrame:
    """id, vec and the columns that order them."""
    return read(spark, path).select(F.col("episode_id").alias("id"), F.col("obs").alias("vec"), "run_id", "sequence", "row")


def metric_of(spark: SparkSession, path: str) -> str | None:
    """The metric that was saved along, if any."""
    return read(spark, path).schema["obs"].metadata.get("metric")
