"""Exact nearest neighbours. Ties go to the smaller slot, NaN scores last."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidevec.errors import EmptyIndex, KTooLarge, WrongDimension
from tidevec.functions.scores import METRICS, checked, score
from tidevec.schemas import HITS

#: Queries that are broadcast at once (64 MB of doubles at 1,024 dimensions), and hits that a task keeps for them.
QUERY_BLOCK, BLOCK_HITS = 8_192, 2_000_000
#: Vectors from which the bounds of a search by expressions are taken, at least (16 k if that is more).
SAMPLE_VECTORS = 4_096


def check_k(k: int, count: int) -> None:
    """Raise as a search does: on an empty index for any k, then for k over the number of vectors."""
    if count == 0:
        raise EmptyIndex("the index has no vectors")
    if k < 0 or k > count:
        raise KTooLarge(f"k is {k}, the index has {count} vectors")


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", count: int | None = None) -> DataFrame:
    """rank, id, score, slot of the k vectors of vectors(slot, id, vec) nearest to query.

    count is the number of vectors if it is known; otherwise they are counted to check k. The plan is one
    narrow scan and a bounded queue in each task.
    """
    check_k(k, vectors.count() if count is None else count)
    if k == 0:
        return vectors.sparkSession.createDataFrame([], HITS)
    values = [float(x) for x in query]
    if not values:
        raise WrongDimension("an empty query")
    q = F.array(*(F.lit(float(np.float32(x))).cast("float") for x in values))
    scored = vectors.select("id", score(metric, checked(F.col("vec"), len(values)), q).alias("score"), "slot")
    best = scored.orderBy("score", "slot").limit(k)
    return best.select(F.row_number().over(Window.orderBy("score", "slot")).alias("rank"), "id", "score", "slot")


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", dim: int | None = None) -> DataFrame:
    """qid, rank, id, score, slot: the k nearest vectors of each row of queries(qid, vec), fewer if there are fewer.

    Expressions only. The queries, a stated set, are broadcast in blocks and scored where the vectors lie. A
    sample of the vectors gives each query a bound, the k-th best score in it: nothing worse is among the k
    best of all. So of the scores few are handed on to be ranked, not vectors times queries.
    """
    if k <= 0:
        return _empty(vectors)
    out, width = None, dim or _dim(vectors)
    every = max(1, vectors.count() // max(SAMPLE_VECTORS, 16 * k))
    checked_ = vectors.select("id", "slot", checked(F.col("vec"), width).alias("vec"))
    sample = checked_.where(F.pmod(F.xxhash64("slot"), F.lit(every)) == 0)
    measure = score(metric, F.col("vec"), F.col("qvec"))
    for block in _blocks(queries, k):
        q = block.select("qid", checked(F.col("vec"), width).alias("qvec"))
        if every > 1:
            ranked = sample.crossJoin(F.broadcast(q)).select("qid", measure.alias("score"), "slot").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "slot")))
            q = q.join(F.broadcast(ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("bound"))), "qid", "left")
        else:
            q = q.withColumn("bound", F.lit(None).cast("double"))
        scored = checked_.crossJoin(F.broadcast(q)).select("qid", "id", measure.alias("score"), "slot", "bound").where("bound is null or score <= bound")
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "slot"))).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out.select("qid", "rank", "id", "score", "slot") if out is not None else _empty(vectors)


def knn_arrow(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", dim: int | None = None) -> DataFrame:
    """As knn, scored in numpy by Arrow batch; each task keeps its k best of each query, then ranks meet.

    Sums run dimension by dimension, so scores are those of the expressions to the last bit.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    if k <= 0:
        return _empty(vectors)
    spark, width, out = vectors.sparkSession, dim or _dim(vectors), None
    for block in _blocks(queries, k):
        rows = block.collect()
        if not rows:
            continue
        if any(r.vec is None or len(r.vec) != width or None in r.vec for r in rows):
            raise WrongDimension(f"queries need {width} elements")
        table = spark.sparkContext.broadcast(([r.qid for r in rows], np.array([r.vec for r in rows], np.float32).astype(np.float64)))

        def best(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            qids, q = table.value
            kept = (np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64))
            for b in batches:
                vec = b.column(2)
                if vec.null_count or len(vec.flatten()) != width * len(vec) or vec.flatten().null_count or set(np.diff(vec.offsets.to_numpy())) - {width}:
                    raise ValueError(f"wrong_dimension: expected {width} elements")
                v = vec.flatten().to_numpy().reshape(len(vec), width).astype(np.float64)
                ids, slots = b.column(0).to_numpy(), b.column(1).to_numpy()
                step, parts = max(1, 4_000_000 // max(1, len(v))), []
                for i in range(0, len(q), step):
                    part = q[i : i + step]
                    total = np.zeros((len(part), len(v)))
                    for d in range(width):
                        total += (v[None, :, d] - part[:, None, d]) ** 2 if metric == "l2" else v[None, :, d] * part[:, None, d]
                    total = 0.0 - total if metric == "ip" else total
                    both = [np.concatenate((x[i : i + step], np.broadcast_to(y, total.shape)), axis=1) for x, y in zip(kept, (total, slots, ids))]
                    order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                    parts.append([np.take_along_axis(x, order, 1) for x in both])
                kept = tuple(np.concatenate(x) for x in zip(*parts))
            total, slots, ids = kept
            if total.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids, np.int64), total.shape[1])), pa.array(ids.ravel()), pa.array(total.ravel()), pa.array(slots.ravel())], ["qid", "id", "score", "slot"])

        found = vectors.select("id", "slot", "vec").mapInArrow(best, "qid long, id long, score double, slot long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "slot"))).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("qid", "rank", "id", "score", "slot") if out is not None else _empty(vectors)


def two_stage_top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str, groups: int) -> DataFrame:
    """As top_k, with an explicit partial stage: the k best of each of `groups` groups of slots, then the best of those."""
    q = F.array(*(F.lit(float(np.float32(x))).cast("float") for x in query))
    scored = vectors.select("id", score(metric, checked(F.col("vec"), len(query)), q).alias("score"), "slot", (F.col("slot") % groups).alias("_group"))
    part = scored.withColumn("_r", F.row_number().over(Window.partitionBy("_group").orderBy("score", "slot"))).where(F.col("_r") <= k)
    best = part.orderBy("score", "slot").limit(k)
    return best.select(F.row_number().over(Window.orderBy("score", "slot")).alias("rank"), "id", "score", "slot")


def _dim(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vec").alias("n")).first()
    return first.n if first else 0


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "qid BIGINT, " + HITS)


def _blocks(queries: DataFrame, k: int) -> list[DataFrame]:
    """queries in parts of about QUERY_BLOCK rows, and of BLOCK_HITS hits at most, by hash of qid."""
    n = -(-queries.count() // max(1, min(QUERY_BLOCK, BLOCK_HITS // k)))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]
