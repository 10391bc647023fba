"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidevec.errors import TidevecError
from tidevec.functions import ids
from tidevec.functions.scores import register as register_scores
from tidevec.functions.scores import score
from tidevec.operators import archive, placement, search
from tidevec.operators.index import VectorIndex
from tidevec.sources import corpus
from tidevec.sources.shared import in_folder
from tidevec.streaming.append import append_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K, DIM, CAPACITY = 10, 64, 300
#: Ids divisible by this are the query set of searches for many vectors.
QUERY_STEP = 100


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("slot"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return _vectors(spark, sf_dir).where("slot = 0").first().vec


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(f"id % {QUERY_STEP} = 0").select(F.col("id").alias("qid"), "vec")


# Vectors

_L2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"
_IP = "0 - list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_SCORES = "SELECT vec_id AS id, {score} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_TOP = "SELECT CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank, id, score, id AS slot FROM (" + _SCORES + f") ORDER BY score, id LIMIT {K}"
_KNN = f"""SELECT qid, CAST(rank AS INTEGER) AS rank, id, score, id AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM (
        SELECT q.vec_id AS qid, v.vec_id AS id, {{score}} AS score FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_STEP} = 0)) WHERE rank <= {K}"""
_one = {"l2": _L2.format(a="embedding", b="q"), "ip": _IP.format(a="embedding", b="q")}
_many = {"l2": _L2.format(a="v.embedding", b="q.embedding"), "ip": _IP.format(a="v.embedding", b="q.embedding")}


def _index(spark: SparkSession, sf_dir: str, mode: str = "sql") -> VectorIndex:
    return VectorIndex(spark, DIM, "l2", mode=mode).append(_vectors(spark, sf_dir))


@_query("SELECT count(*) AS n FROM embeddings")
def vec_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_index(spark, sf_dir).count(),)], "n BIGINT")


@_query("SELECT CAST(min(len(embedding)) AS BIGINT) AS dim FROM embeddings")
def vec_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension that the index has checked of every vector."""
    index = _index(spark, sf_dir)
    return index.vectors.agg(F.count(F.lit(1))).select(F.lit(index.dim).cast("long").alias("dim"))


@_query("SELECT true AS is_empty, 'arrow' AS mode, count(*) = 0 AS after_append FROM embeddings")
def vec_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index is empty; after an append it is not."""
    index = VectorIndex(spark, DIM, mode="arrow")
    before, mode = index.is_empty(), index.mode
    return spark.createDataFrame([(before, mode, index.append(_vectors(spark, sf_dir)).is_empty())], "is_empty BOOLEAN, mode STRING, after_append BOOLEAN")


@_query("SELECT vec_id AS slot, vec_id AS id FROM embeddings")
def vec_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).ids()


@_query("SELECT vec_id AS slot, CAST(d - 1 AS INTEGER) AS dimension, embedding[d]::DOUBLE AS value FROM embeddings, range(1, 65) r(d)")
def vec_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).data().withColumn("value", F.col("value").cast("double"))


@_query("SELECT count(*) AS vectors, 64::INTEGER AS dim, count(*) * 264 AS bytes, count(*) * 264 // 1048576 AS mib, 'l2' AS metric, 'arrow' AS mode, false AS fast_path_missing FROM embeddings")
def vec_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index brought into memory holds; executors, cores and partitions, which differ by session, are left out."""
    return _index(spark, sf_dir, "arrow").cache().describe().drop("executors", "cores", "partitions")


@_query(_SCORES.format(score=_one["l2"]))
def vec_score_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit([float(x) for x in _first(spark, sf_dir)]).cast("array<float>")
    return _vectors(spark, sf_dir).select("id", score("l2", F.col("vec"), q).alias("score"))


@_query(_SCORES.format(score=_one["ip"]))
def vec_score_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit([float(x) for x in _first(spark, sf_dir)]).cast("array<float>")
    return _vectors(spark, sf_dir).select("id", score("ip", F.col("vec"), q).alias("score"))


@_query(_SCORES.format(score=_one["l2"]))
def vec_score_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_scores(spark)
    q = F.lit([float(x) for x in _first(spark, sf_dir)]).cast("array<float>")
    return _vectors(spark, sf_dir).withColumn("q", q).selectExpr("id", "tv_l2_squared(vec, q) AS score")


@_query(_TOP.format(score=_one["l2"]))
def vec_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), K, "l2")


@_query(_TOP.format(score=_one["ip"]))
def vec_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), K, "ip")


@_query(_TOP.format(score=_one["l2"]))
def vec_topk_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.two_stage_top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), K, "l2", 12)


@_query(_KNN.format(score=_many["l2"]))
def vec_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(_vectors(spark, sf_dir), _queries(spark, sf_dir), K, "l2", DIM)


@_query(_KNN.format(score=_many["ip"]))
def vec_knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(_vectors(spark, sf_dir), _queries(spark, sf_dir), K, "ip", DIM)


@_query(_KNN.format(score=_many["l2"]))
def vec_knn_arrow_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn_arrow(_vectors(spark, sf_dir), _queries(spark, sf_dir), K, "l2", DIM)


@_query(_KNN.format(score=_many["ip"]))
def vec_knn_arrow_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn_arrow(_vectors(spark, sf_dir), _queries(spark, sf_dir), K, "ip", DIM)


@_query(f"SELECT vec_id AS slot, vec_id AS id FROM embeddings ORDER BY vec_id LIMIT {CAPACITY}")
def vec_capacity_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append to an index of fixed capacity: the feature keeps what fits."""
    from tidevec.errors import CapacityExceeded

    index = VectorIndex(spark, DIM, capacity=CAPACITY)
    try:
        index.append(_vectors(spark, sf_dir))
    except CapacityExceeded:
        pass
    return index.vectors.select("slot", "id")


@_query(_TOP.format(score=_one["l2"]))
def vec_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index object end to end: append in id order, then search by the Arrow path."""
    return VectorIndex(spark, DIM, "l2", mode="arrow").append(_vectors(spark, sf_dir)).search(_first(spark, sf_dir), K)


@_query(_TOP.format(score=_one["l2"]))
def vec_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search goes on by expressions when its fast path fails."""
    index = _index(spark, sf_dir, "arrow")

    def fails() -> list:
        raise PySparkRuntimeError("the fast path is away")

    if index._fast(fails) is not None or index.mode != "sql":
        raise AssertionError("no fallback")
    return index.search(_first(spark, sf_dir), K)


@_query(_TOP.format(score=_one["l2"]))
def vec_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors arrive by a stream; the index that follows it searches them."""

    def run(path: str) -> DataFrame:
        _vectors(spark, sf_dir).select("id", "vec").write.parquet(f"{path}/in")
        stream = spark.readStream.schema("id BIGINT, vec ARRAY<FLOAT>").parquet(f"{path}/in")
        append_stream(stream, f"{path}/table", f"{path}/state", DIM).awaitTermination()
        return VectorIndex(spark, DIM).follow(f"{path}/table").search(_first(spark, sf_dir), K)

    return in_folder(spark, run)


@_query("SELECT CAST(CASE WHEN mib = 0 THEN 150 ELSE mib * 1000 // 25600 + 150 END AS BIGINT) AS budget_ms FROM (SELECT count(*) * (64 * 4 + 8) // 1048576 AS mib FROM embeddings)")
def vec_load_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = VectorIndex(spark, DIM, mode="arrow").append(_vectors(spark, sf_dir))
    return spark.createDataFrame([(index.load_budget_ms(),)], "budget_ms BIGINT")


# Corpus files

_CORPUS = """SELECT 1::BIGINT AS run_id, 0::BIGINT AS sequence, 0::BIGINT AS seed, vec_id::INTEGER AS row, vec_id AS episode_id, 0::BIGINT AS env_id, 0::BIGINT AS step,
    len(embedding)::INTEGER AS dim, embedding[1]::DOUBLE AS first, 0::INTEGER AS action, 0::DOUBLE AS reward, 0::INTEGER AS terminal, 1::INTEGER AS mask, 0::DOUBLE AS value, 0::DOUBLE AS logp, 0::INTEGER AS state FROM embeddings"""


@_query(_CORPUS)
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.to_corpus(_vectors(spark, sf_dir))
    return c.select(
        "run_id", "sequence", "seed", "row", "episode_id", "env_id", "step", F.size("obs").alias("dim"), F.col("obs")[0].cast("double").alias("first"), "action", F.col("reward").cast("double").alias("reward"), "terminal",
        F.col("action_mask")[0].alias("mask"), F.col("value").cast("double").alias("value"), F.col("logp").cast("double").alias("logp"), F.col("states")[0].alias("state"),
    )


@_query("SELECT vec_id AS slot, vec_id AS id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save to the shared folder and load into a new index."""

    def run(path: str) -> DataFrame:
        corpus.save(_vectors(spark, sf_dir), path)
        return VectorIndex(spark, DIM).load(path).vectors.select("slot", "id", F.col("vec")[0].cast("double").alias("first"), F.col("vec")[DIM - 1].cast("double").alias("last"))

    return in_folder(spark, run)


@_query("SELECT * FROM (VALUES ('no file', 'io'), ('no corpus', 'io')) t(path, code)")
def corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no corpus is refused with a code, and the index stays as it was."""
    index, out = VectorIndex(spark, DIM), []
    for name, path in (("no file", f"{sf_dir}/none.parquet"), ("no corpus", f"{sf_dir}/region.parquet")):
        try:
            index.load(path)
        except TidevecError as e:
            out.append((name, e.code))
    return spark.createDataFrame(out if index.is_empty() else [], "path STRING, code STRING")


# Time-ordered ids

_EVENTS = """(SELECT *, (sec << 36) | (ticker << 28) | source AS id FROM (
    SELECT event_id, sec, user_id & 268435455 AS source, (row_number() OVER (PARTITION BY sec, user_id ORDER BY event_id) - 1) & 255 AS ticker FROM (
        SELECT event_id, user_id, epoch_us(ts) // 1000000 - 1704067200 AS sec FROM events)))"""
_DAY = 2 * 86_400
_CUTOFF = 1_296_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, sec, ticker, source and id of each event."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - ids.EPOCH_BASE
    e = e.select("event_id", "user_id", sec.cast("long").alias("sec"), F.col("user_id").bitwiseAND((1 << ids.SOURCE_BITS) - 1).alias("source"))
    rank = F.row_number().over(Window.partitionBy("sec", "user_id").orderBy("event_id")) - 1
    e = e.withColumn("ticker", rank.cast("long").bitwiseAND(255))
    return e.select("event_id", "sec", "ticker", "source", ids.encode(F.col("sec"), F.col("ticker"), F.col("source")).alias("id"))


@_query(f"SELECT event_id, id FROM {_EVENTS}")
def id_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "id")


@_query(f"SELECT event_id, (id >> 36) & 134217727 AS sec, (id >> 28) & 255 AS ticker, id & 268435455 AS source, 0::BIGINT AS high FROM {_EVENTS}")
def id_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return _events(spark, sf_dir).select("event_id", ids.seconds_of(i).alias("sec"), ids.ticker_of(i).alias("ticker"), ids.source_of(i).alias("source"), ids.high_of(i).cast("long").alias("high"))


@_query(f"SELECT event_id, (id >> 36) & 134217727 AS sec, (id >> 28) & 255 AS ticker, id & 268435455 AS source, id >> 28 AS cold_key FROM {_EVENTS}")
def id_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids.register(spark)
    made = _events(spark, sf_dir).selectExpr("event_id", "tv_id_encode(sec, ticker, source) AS id")
    return made.selectExpr("event_id", "tv_id_seconds(id) AS sec", "tv_id_ticker(id) AS ticker", "tv_id_source(id) AS source", "tv_id_cold_key(id) AS cold_key")


@_query(f"SELECT event_id, id FROM {_EVENTS} WHERE id >= ({_DAY}::BIGINT << 36) AND id < ({_DAY + 86_400}::BIGINT << 36)")
def id_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written sorted by id; the range of seconds is pushed to the scan of those files."""
    return in_folder(spark, lambda path: _by_time(spark, sf_dir, path).where(ids.between_seconds(F.col("id"), _DAY, _DAY + 86_400)).select("event_id", "id"))


def _by_time(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    archive.write_by_time(_events(spark, sf_dir), path)
    return spark.read.parquet(path)


@_query(f"SELECT event_id, sec FROM {_EVENTS} WHERE id = (SELECT id FROM {_EVENTS} WHERE event_id = 7)")
def id_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(path: str) -> DataFrame:
        e = _by_time(spark, sf_dir, path)
        return archive.lookup(e, e.where("event_id = 7").first().id).select("event_id", "sec")

    return in_folder(spark, run)


@_query(f"SELECT event_id, sec FROM {_EVENTS} WHERE event_id = 7")
def id_exact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return archive.lookup(e, e.where("event_id = 7").first().id, 7, tie="event_id").select("event_id", "sec")


@_query(f"SELECT CAST(source % 16 AS INTEGER) AS shard, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(archive.shard(F.col("id"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT CASE WHEN sec < {_CUTOFF} THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def compaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.split_by_age(_events(spark, sf_dir), _CUTOFF).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT event_id, id, id >> 28 AS cold_key, CAST(sec // {archive.CADENCE_SECONDS // 8} AS INTEGER) AS quarter FROM {_EVENTS} WHERE sec < {_CUTOFF}")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after two compactions, the first of which is run twice: each cold row is there once."""
    cadence = archive.CADENCE_SECONDS // 8

    def run(path: str) -> DataFrame:
        e = _events(spark, sf_dir)
        for now in (_CUTOFF // 2, _CUTOFF // 2, _CUTOFF):
            archive.compact(e, now + cadence, path, cadence=cadence, tie="event_id")
        return spark.read.parquet(path).select("event_id", "id", "cold_key", "quarter")

    return in_folder(spark, run)


_LEDGER = f"""SELECT event_id, id, id >> 28 AS cold_key, least(row_number() OVER w - 1, 255) AS before, least(count(*) OVER (PARTITION BY id >> 28) - row_number() OVER w, 255) AS after
    FROM {_EVENTS} WINDOW w AS (PARTITION BY id >> 28 ORDER BY id, event_id)"""


@_query(_LEDGER)
def collision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.ledger(_events(spark, sf_dir), tie="event_id").select("event_id", "id", "cold_key", "before", "after")


@_query(f"SELECT * FROM ({_LEDGER}) WHERE cold_key = (SELECT min(cold_key) FROM ({_LEDGER}) WHERE after > 0)")
def collision_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = archive.ledger(_events(spark, sf_dir), tie="event_id").select("event_id", "id", "cold_key", "before", "after")
    key = cold.where("after > 0").agg(F.min("cold_key").alias("k")).first().k
    return archive.cluster(cold, -1 if key is None else key)


# Accelerators

_REGISTRY = "(VALUES (0, 0, 0, 'cuda', 25, 'Free', 16384, 0), (1, 0, 1, 'cuda', 30, 'Free', 16384, 0), (256, 1, 0, 'cuda', 25, 'Free', 16384, 0), (257, 1, 1, 'cuda', 30, 'Free', 16384, 0)) a(id, box_id, local_index, backend, caps, state, mem_total_mib, mem_used_mib)"
_MASKS = (0, 1, 2, 3, 8)


@_query(f"SELECT id::BIGINT AS id, box_id, local_index, backend, caps::BIGINT AS caps, state, mem_total_mib::BIGINT AS mem_total_mib, mem_used_mib::BIGINT AS mem_used_mib FROM {_REGISTRY}")
def accel_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.Registry().frame(spark).drop("name")


@_query(f"SELECT id::BIGINT AS id, caps::BIGINT AS caps FROM {_REGISTRY} WHERE id IN (257, 9999)")
def accel_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [placement.Registry().by_id(i) for i in (257, 9_999)]
    return spark.createDataFrame([(a.id, a.caps) for a in found if a], "id BIGINT, caps BIGINT")


@_query(f"SELECT count(*) AS n FROM {_REGISTRY}")
def accel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(placement.Registry().count(),)], "n BIGINT")


@_query("SELECT * FROM (VALUES ('at first', true, 'ok'), ('off', false, 'no_runner'), ('on again', true, 'ok')) t(runner, active, outcome)")
def accel_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that needs a capability is placed only while its backend has a runner."""
    registry, out = placement.Registry(), []
    for k, (name, active) in enumerate((("at first", None), ("off", False), ("on again", True))):
        if active is not None:
            registry.set_runner("cuda", active)
        outcome = registry.schedule_all([placement.Job(k, placement.FP64, 1_000)])[0][1]
        out.append((name, registry.runner_active("cuda"), outcome))
    return spark.createDataFrame(out, "runner STRING, active BOOLEAN, outcome STRING")


def _each_mask(column: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {m}::BIGINT AS mask, CAST({value} AS BIGINT) AS {column} FROM {_REGISTRY} WHERE state = 'Free' AND (caps & {m}) = {m}" for m in _MASKS)


@_query(_each_mask("n", "count(*)"))
def accel_free_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = placement.Registry()
    parts = [registry.free_count(spark, m).select(F.lit(m).cast("long").alias("mask"), "n") for m in _MASKS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@_query(_each_mask("free_mib", "coalesce(sum(mem_total_mib - mem_used_mib), 0)"))
def accel_free_mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = placement.Registry()
    parts = [registry.free_memory(spark, m).select(F.lit(m).cast("long").alias("mask"), "free_mib") for m in _MASKS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@_query(f"SELECT id::BIGINT AS id, (mem_total_mib - mem_used_mib)::BIGINT AS free_mib FROM {_REGISTRY} WHERE (caps & 1) = 1 AND mem_total_mib - mem_used_mib >= 8000 ORDER BY 2 DESC, 1 LIMIT 1")
def accel_place_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place_one(placement.Registry().frame(spark), placement.FP64, 8_000, {"cuda"})


@_query("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 'ok'), (2, 256, 'ok'), (3, NULL, 'none_free'), (4, 1, 'ok'), (5, NULL, 'memory_too_small'), (6, 257, 'ok')) t(job_id, accel_id, outcome)")
def accel_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placement
    jobs = [p.Job(1, p.FP64, 8_000), p.Job(2, p.FP64, 8_000), p.Job(3, p.FP64, 8_000), p.Job(4, p.VIDEO_ENCODE, 4_000), p.Job(5, p.VECTOR_SEARCH, 20_000), p.Job(6, p.VECTOR_SEARCH, 12_000)]
    return spark.createDataFrame([(j.job_id, j.accel_id, code) for j, code in p.Registry().schedule_all(jobs)], "job_id BIGINT, accel_id BIGINT, outcome STRING")


@_query("SELECT * FROM (VALUES (0::BIGINT, 'Free', 0::BIGINT), (1, 'ColdBoot', 0), (256, 'Allocated', 4000), (257, 'Fault', 0)) t(id, state, mem_used_mib)")
def accel_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place two jobs, release one, fault one card and begin a load on another."""
    r, p = placement.Registry(), placement
    first = r.schedule(p.Job(1, p.FP64, 8_000))
    r.schedule(p.Job(2, p.FP64, 4_000))
    r.release(first.accel_id)
    r.set_state(257, "Fault")
    r.cold_boot(1, 12_288)
    return r.frame(spark).select("id", "state", "mem_used_mib")


@_query("SELECT mib, CASE WHEN mib = 0 THEN 150 ELSE mib * 1000 // 25600 + 150 END AS budget_ms, CASE WHEN mib = 0 THEN 150 ELSE mib * 1000 // 25600 + 150 END <= 1000 AS in_target FROM (VALUES (0::BIGINT), (1), (8192), (12288), (16384), (32768)) t(mib)")
def load_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.createDataFrame([(x,) for x in (0, 1, 8_192, 12_288, 16_384, 32_768)], "mib BIGINT")
    return sizes.withColumn("budget_ms", placement.budget_column(F.col("mib"))).withColumn("in_target", placement.within_target(F.col("budget_ms")))
