"""Hot and cold tables of rows keyed by time-ordered ids: compaction, collision ledger, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidevec.functions.ids import cold_key, seconds_of, source_of
from tidevec.sources.shared import exists

#: Seconds of the compaction cadence (a quarter of a year) and the ledger's largest count (8 bits).
CADENCE_SECONDS, LEDGER_MAX = 7_889_400, 255


def split_by_age(rows: DataFrame, cutoff_seconds: int, id_column: str = "id") -> DataFrame:
    """rows with tier: 'cold' before the cutoff, else 'hot'."""
    return rows.withColumn("tier", F.when(seconds_of(F.col(id_column)) < cutoff_seconds, "cold").otherwise("hot"))


def compact(rows: DataFrame, now_seconds: int, path: str, id_column: str = "id", cadence: int = CADENCE_SECONDS, tie: str = "id_ext") -> DataFrame:
    """Add rows older than one cadence to the archive at path, by quarter, with their cold key; returns the rest.

    A row is known by its id and tie (without a tie column, by all its columns). What the archive has of the
    same quarters is left out, so a compaction that was broken off or is run again adds each row once.
    """
    spark, keys = rows.sparkSession, [id_column, tie] if tie in rows.columns else rows.columns
    tiers = split_by_age(rows, max(0, now_seconds - cadence), id_column)
    cold = tiers.where("tier = 'cold'").drop("tier").withColumns({"cold_key": cold_key(F.col(id_column)), "quarter": F.floor(seconds_of(F.col(id_column)) / cadence).cast("int")})
    if exists(spark, path):
        there = spark.read.schema(cold.schema).parquet(path)
        same = reduce(lambda a, b: a & b, (F.col(f"c.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ["quarter", *keys]))
        cold = cold.alias("c").join(there.alias("t"), same, "left_anti")
    cold.write.mode("append").partitionBy("quarter").parquet(path)
    return tiers.where("tier = 'hot'").drop("tier")


def write_by_time(rows: DataFrame, path: str, id_column: str = "id") -> None:
    """Write rows sorted by id over all files, so that ranges of seconds and single ids skip files and row groups."""
    rows.repartitionByRange(id_column).sortWithinPartitions(id_column).write.parquet(path)


def ledger(rows: DataFrame, id_column: str = "id", tie: str = "id_ext") -> DataFrame:
    """rows with cold_key, before and after: how many rows of the same cold key come before and after, by id then tie, at most 255.

    A cold key holds one second and ticker over all sources; its rows are counted where they meet, and only they.
    """
    keyed = rows.withColumn("cold_key", cold_key(F.col(id_column)))
    place = F.row_number().over(Window.partitionBy("cold_key").orderBy(id_column, tie))
    total = F.count(F.lit(1)).over(Window.partitionBy("cold_key"))
    capped = lambda x: F.least(x, F.lit(LEDGER_MAX)).cast("long")
    return keyed.withColumns({"before": capped(place - 1), "after": capped(total - place)})


def cluster(cold: DataFrame, key: int) -> DataFrame:
    """All rows of one cold key."""
    return cold.where(F.col("cold_key") == F.lit(key).cast("long"))


def lookup(rows: DataFrame, id_: int, id_ext: int | None = None, id_column: str = "id", tie: str = "id_ext") -> DataFrame:
    """The row of an id, with id_ext if the id alone is not exact."""
    found = rows.where(F.col(id_column) == F.lit(id_).cast("long"))
    return found if id_ext is None else found.where(F.col(tie) == F.lit(id_ext).cast("long"))


def shard(id_: Column, shards: int) -> Column:
    """Shard of an id: its source, dealt over so many shards."""
    return (source_of(id_) % shards).cast("int")


def write_sharded(rows: DataFrame, path: str, shards: int, id_column: str = "id") -> None:
    """Write rows sorted by id in folders by shard, so that lookups prune folders and row groups."""
    marked = rows.withColumn("shard", shard(F.col(id_column), shards))
    marked.repartition("shard").sortWithinPartitions("shard", id_column).write.mode("overwrite").partitionBy("shard").parquet(path)
