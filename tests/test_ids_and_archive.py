import pytest
from pyspark.sql import functions as F

from tidevec.functions import ids
from tidevec.operators import archive

TOP = (134217727, 255, 268435455)


def test_codec(spark):
    df = spark.createDataFrame([(0, 0, 0), TOP, (5, 300, 1)], "s BIGINT, t BIGINT, src BIGINT").withColumn("id", ids.encode(F.col("s"), F.col("t"), F.col("src")))
    out = df.select("id", ids.seconds_of(F.col("id")).alias("s"), ids.ticker_of(F.col("id")).alias("t"), ids.source_of(F.col("id")).alias("src"), ids.high_of(F.col("id")).alias("h")).collect()
    assert [tuple(r) for r in out] == [(0, 0, 0, 0, 0), (2**63 - 1, *TOP, 0), ((5 << 36) | (44 << 28) | 1, 5, 44, 1, 0)]
    one = spark.createDataFrame([(-1,)], "id BIGINT")
    r = one.select(ids.seconds_of(F.col("id")).alias("s"), ids.ticker_of(F.col("id")).alias("t"), ids.source_of(F.col("id")).alias("src"), ids.high_of(F.col("id")).alias("h"), ids.encode(*(F.lit(x) for x in TOP), F.lit(1)).alias("id")).first()
    assert tuple(r) == (*TOP, 1, -1)
    assert str(spark.sql("SELECT 1").select(ids.time_of(F.lit(0).cast("long"))).first()[0]) == "2024-01-01 00:00:00"


def test_unsigned_order(spark):
    df = spark.createDataFrame([(5,), (-1,), (0,), (-(1 << 63),)], "id BIGINT")
    assert [r.id for r in df.orderBy(ids.unsigned_order(F.col("id"))).collect()] == [0, 5, -(1 << 63), -1]
    ids.register(spark)
    assert [r.id for r in df.selectExpr("id", "tv_id_order(id) AS place").orderBy("place").collect()] == [0, 5, -(1 << 63), -1]


def test_time_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(ids.encode(F.col("id"), F.lit(0), F.lit(3)).alias("id")).write.parquet(path)
    df = spark.read.parquet(path).where(ids.between_seconds(F.col("id"), 10, 20))
    assert df.count() == 10
    assert "GreaterThanOrEqual(id" in df._jdf.queryExecution().executedPlan().toString()


def test_ledger_saturates(spark):
    df = spark.range(300).select(F.lit(7).cast("long").alias("id"), F.col("id").alias("id_ext"))
    out = {r.id_ext: (r.before, r.after) for r in archive.ledger(df).collect()}
    assert out[0] == (0, 255) and out[299] == (255, 0) and out[100] == (100, 199)


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "cold")
    rows = spark.range(0, 40).select(ids.encode(F.col("id") * 1_000_000, F.lit(0), F.col("id")).alias("id"), F.col("id").alias("id_ext"))
    hot = archive.compact(rows, 39_000_000, path)
    cold = spark.read.parquet(path)
    assert hot.count() + cold.count() == 40 and hot.count() == 8
    assert {r.quarter for r in cold.select("quarter").distinct().collect()} == {0, 1, 2, 3}
    assert archive.cluster(cold, cold.first().cold_key).count() == 1
    assert archive.lookup(rows, rows.first().id, 0).count() == 1 and archive.lookup(rows, rows.first().id, 1).count() == 0


def test_sharded_files(spark, tmp_path):
    path = str(tmp_path / "s")
    archive.write_sharded(spark.range(100).select(ids.encode(F.col("id"), F.lit(0), F.col("id")).alias("id")), path, 4)
    got = spark.read.parquet(path)
    assert got.where("shard = 1").count() == 25
    assert got.select(F.max(F.abs(ids.source_of(F.col("id")) % 4 - F.col("shard")))).first()[0] == 0


@pytest.mark.parametrize("column", ["source", "ticker"])
def test_fields_are_cut_to_width(spark, column):
    got = spark.range(1).select(ids.encode(F.lit(0), F.lit((1 << 8) if column == "ticker" else 0), F.lit((1 << 28) if column == "source" else 0)).alias("id")).first()
    assert got.id == 0


def test_compaction_again(spark, tmp_path):
    """A compaction that is run again, or goes on later, adds each row once; rows that share an id stay apart."""
    path = str(tmp_path / "cold")
    rows = spark.range(0, 40).select(ids.encode(F.col("id") * 1_000_000, F.lit(0), F.lit(3)).alias("id"), F.col("id").alias("id_ext"))
    rows = rows.union(rows.withColumn("id_ext", F.col("id_ext") + 1_000))
    for now in (20_000_000, 20_000_000, 39_000_000):
        hot = archive.compact(rows, now, path)
    cold = spark.read.parquet(path)
    assert cold.count() == cold.select("id", "id_ext").distinct().count() == 64 and hot.count() == 16


def test_files_by_time_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    archive.write_by_time(spark.range(1_000).select(ids.encode(F.col("id"), F.lit(0), F.col("id")).alias("id")).repartition(5), path)
    df = archive.lookup(spark.read.parquet(path), spark.read.parquet(path).first().id)
    assert df.count() == 1 and "EqualTo(id" in df._jdf.queryExecution().executedPlan().toString()
