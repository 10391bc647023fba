"""Structured Streaming into a vector table: each micro-batch is appended, later searches see it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidevec.functions.scores import checked
from tidevec.operators.index import with_slots
from tidevec.schemas import VECTORS
from tidevec.sources.appended import appended as table
from tidevec.sources.shared import exists

__all__ = ["append_stream", "table"]


def append_stream(stream: DataFrame, path: str, checkpoint: str, dim: int, order: Sequence[str] | None = None) -> StreamingQuery:
    """Start a query that appends stream(id, vec) to the Parquet table at path, a folder for each batch.

    Slots go on from those of the batches before, within a batch in the given order (by default that of slot, if
    the stream has one, else of id). A batch that is tried again
    overwrites its own folder with the same slots, so each row is there once. VectorIndex.follow(path) searches it.
    """

    order = order or (("slot",) if "slot" in stream.columns else ("id",))

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base = 0
        if exists(spark, path):
            base = spark.read.schema(VECTORS + ", batch BIGINT").option("basePath", path).parquet(path).where(F.col("batch") < epoch).count()
        new = batch.select("id", checked(F.col("vec").cast("array<float>"), dim).alias("vec"), *(c for c in order if c not in ("id", "vec")))
        slotted, _, kept = with_slots(new, order, base)
        slotted.select("slot", "id", "vec").write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
