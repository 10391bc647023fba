import math

import numpy as np
import pytest

from tidevec.errors import CapacityExceeded, CorpusError, EmptyIndex, KTooLarge, NotInitialised, WrongDimension
from tidevec.operators.index import VectorIndex
from tidevec.operators.search import knn, knn_arrow, top_k, two_stage_top_k
from tidevec.sources import corpus
from tidevec.streaming.append import append_stream, table

VECS = "id BIGINT, vec ARRAY<FLOAT>"
SLOTTED = "slot BIGINT, id BIGINT, vec ARRAY<FLOAT>"


def fill(spark, rows, dim, metric="l2", capacity=None, mode="sql"):
    index = VectorIndex(spark, dim, metric, capacity, mode)
    return index.append(spark.createDataFrame([(i, r, [float(x) for x in v]) for i, (r, v) in enumerate(rows)], "at INT, " + VECS), order=("at",))


def hits(df):
    return [(r.id, r.slot) for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("mode", ["sql", "arrow"])
def test_l2_known_answer(spark, mode):
    index = fill(spark, [(100, [1.0, 0, 0, 0]), (101, [0, 1.0, 0, 0]), (102, [1.0, 1, 0, 0])], 4, capacity=8, mode=mode)
    out = sorted(index.search([1, 0.1, 0, 0], 3).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.id, r.score) for r in out] == [(1, 100, 0.010000000298023226), (2, 102, 0.8099999973177909), (3, 101, 1.809999997317791)]


@pytest.mark.parametrize("mode", ["sql", "arrow"])
def test_inner_product_ties_and_zero(spark, mode):
    index = fill(spark, [(1, [1.0, 2, 3, 4]), (2, [4.0, 3, 2, 1]), (3, [0.0, 0, 0, 0])], 4, "ip", mode=mode)
    out = sorted(index.search([1, 1, 1, 1], 3).collect(), key=lambda r: r["rank"])
    assert [(r.id, r.score) for r in out] == [(1, -10.0), (2, -10.0), (3, 0.0)]
    assert math.copysign(1, out[2].score) == 1


def test_append_order_and_ties(spark):
    index = fill(spark, [(500, [0.0, 0]), (1, [0.0, 0]), (99999, [0.0, 0]), (1, [0.0, 0])], 2)
    assert [(r.slot, r.id) for r in index.ids().collect()] == [(0, 500), (1, 1), (2, 99999), (3, 1)]
    assert hits(index.search([0, 0], 4)) == [(500, 0), (1, 1), (99999, 2), (1, 3)]
    assert [tuple(r) for r in index.data().limit(3).collect()] == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0)]


def test_bounds(spark):
    index = VectorIndex(spark, 2, capacity=4)
    for k in (0, 1):
        with pytest.raises(EmptyIndex):
            index.search([1, 0], k)
    assert index.is_empty()
    for i in range(1, 5):
        index.add(i, [1.0, 0.0])
    assert index.count() == 4
    with pytest.raises(CapacityExceeded) as e:
        index.add(5, [1.0, 0.0])
    assert e.value.kept == 0 and index.count() == 4
    with pytest.raises(KTooLarge):
        index.search([1, 0], 5)
    assert len(index.search([1, 0], 4).collect()) == 4 and index.search([1, 0], 0).collect() == []
    with pytest.raises(WrongDimension):
        index.search([1, 0, 0], 1)
    with pytest.raises(WrongDimension):
        index.add(1, [1.0])
    index.init("ip")
    assert index.is_empty() and index.metric == "ip"
    index.close()
    with pytest.raises(NotInitialised):
        index.describe()
    with pytest.raises(NotInitialised):
        index.count()


@pytest.mark.parametrize("bad", [[1.0], [1.0, None], None, [1.0, 2.0, 3.0]])
def test_malformed_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 1, bad)], SLOTTED)
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid BIGINT, vec ARRAY<FLOAT>")
    for run in (lambda: top_k(df, [1, 2], 1), lambda: knn(df, q, 1), lambda: knn_arrow(df, q, 1, dim=2)):
        with pytest.raises(Exception, match="wrong_dimension"):
            run().collect()


@pytest.mark.parametrize("first", [True, False])
def test_nan_and_infinity_sort_last(spark, first):
    rows = [(7, [math.nan]), (1, [4.0]), (2, [1.0]), (3, [2.0]), (4, [math.inf])]
    rows = rows if first else rows[1:] + rows[:1]
    for mode in ("sql", "arrow"):
        assert [i for i, _ in hits(fill(spark, rows, 1, mode=mode).search([0], 5))] == [2, 3, 1, 4, 7]


def lcg(state, n):
    out = []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(np.float32(np.float32((state >> 40) & 0xFFFF) / np.float32(65535)) * np.float32(2) - np.float32(1))
    return np.array(out, np.float32)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize(("start", "n", "k", "base"), [(0x123456789, 3000, 10, 1_000_000), (0xDEADBEEFCAFEBABE, 2000, 8, 7_000_000)])
def test_paths_agree(spark, metric, start, n, k, base):
    x = lcg(start, n * 16 + 16)
    data, q = x[: n * 16].reshape(n, 16), x[n * 16 :]
    total = np.zeros(n)
    for d in range(16):
        a, b = data[:, d].astype(float), float(q[d])
        total += (a - b) ** 2 if metric == "l2" else a * b
    total = total if metric == "l2" else 0.0 - total
    want = [(base + i, float(total[i])) for i in np.lexsort((np.arange(n), total))[:k].tolist()]
    df = spark.createDataFrame([(i, base + i, v.tolist()) for i, v in enumerate(data)], SLOTTED)
    queries = spark.createDataFrame([(0, q.tolist())], "qid BIGINT, vec ARRAY<FLOAT>")
    for parts in (1, 7):
        d = df.repartition(parts)
        for out in (top_k(d, q.tolist(), k, metric), two_stage_top_k(d, q.tolist(), k, metric, 12), knn(d, queries, k, metric), knn_arrow(d, queries, k, metric)):
            assert [(r.id, r.score) for r in sorted(out.collect(), key=lambda r: r["rank"])] == want


def test_query_blocks(spark, monkeypatch):
    from tidevec.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    df = spark.createDataFrame([(i, i, [float(i)]) for i in range(20)], SLOTTED)
    q = df.selectExpr("id AS qid", "vec")
    for f in (knn, knn_arrow):
        assert sorted((r.qid, r.id) for r in f(df, q, 1).collect()) == [(i, i) for i in range(20)]
    assert knn(df, q, 0).collect() == [] and knn(df, q.limit(0), 3).collect() == []


def test_corpus(spark, tmp_path):
    path = str(tmp_path / "c")
    index = fill(spark, [(5, [1.0, 2.0]), (3, [3.0, 4.0]), (9, [5.0, 6.0])], 2, "ip")
    index.save(path)
    assert corpus.metric_of(spark, path) == "ip"
    again = VectorIndex(spark, 2).load(path)
    assert [tuple(r) for r in again.vectors.orderBy("slot").collect()] == [(0, 5, [1.0, 2.0]), (1, 3, [3.0, 4.0]), (2, 9, [5.0, 6.0])]
    small = VectorIndex(spark, 2, capacity=2)
    with pytest.raises(CapacityExceeded) as e:
        small.load(path)
    assert e.value.kept == 2 and [r.id for r in small.ids().collect()] == [5, 3]
    with pytest.raises(EmptyIndex):
        VectorIndex(spark, 2).save(path + "2")
    with pytest.raises(CorpusError):
        VectorIndex(spark, 2).load(path + "3")
    spark.range(3).write.parquet(path + "4")
    with pytest.raises(CorpusError):
        VectorIndex(spark, 2).load(path + "4")


def test_modes(spark):
    assert VectorIndex(spark, 2).load_budget_ms() == 0
    index = VectorIndex(spark, 2, mode="arrow")
    assert index.mode == "arrow" and not index.fast_path_missing and index.load_budget_ms() == 150
    assert index.append(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VECS)).cache().count() == 2
    q = spark.createDataFrame([(4, [1.0, 0.0])], "qid BIGINT, vec ARRAY<FLOAT>")
    assert [(r.qid, r.id) for r in index.search_many(q, 1).collect()] == [(4, 1)]
    index.uncache()


def test_stream_appends(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in ([(0, 7, [1.0, 0.0])], [(1, 8, [0.0, 1.0]), (2, 9, [1.0, 1.0])]):
        spark.createDataFrame(part, SLOTTED).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(SLOTTED).parquet(source), target, state, 2).awaitTermination()
    assert [r.id for r in top_k(table(spark, target), [1, 1], 3).orderBy("rank").collect()] == [9, 7, 8]


def test_slots_follow_one_shuffle(spark):
    from tidevec.operators.index import with_slots

    df = spark.range(5_000).selectExpr("id * 7919 % 5003 AS id").repartition(9)
    slotted, n, kept = with_slots(df, ["id"], 10)
    assert n == 5_000 and [r.slot for r in slotted.orderBy("id").collect()] == list(range(10, 5_010))
    assert str(slotted._jdf.queryExecution().optimizedPlan()).count("Window") == 0
    kept.unpersist()


def test_search_goes_on_without_the_fast_path(spark, monkeypatch):
    from pyspark.errors import PySparkRuntimeError

    from tidevec.operators import index as module

    def fails(*args):
        raise PySparkRuntimeError("no worker")

    rows = [(i, [float(i), 0.0]) for i in range(6)]
    q = spark.createDataFrame([(1, [2.2, 0.0])], "qid BIGINT, vec ARRAY<FLOAT>")
    for many in (False, True):
        index = VectorIndex(spark, 2, mode="arrow").append(spark.createDataFrame(rows, VECS))
        with monkeypatch.context() as m:
            m.setattr(module, "knn_arrow", fails)
            hits = index.search_many(q, 2) if many else index.search([2.2, 0.0], 2)
            assert [r.id for r in hits.orderBy("rank").collect()] == [2, 3]
        assert index.mode == "sql" and index.fast_path_missing


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_searches_hand_on_few_rows(spark, monkeypatch, metric):
    """Tasks hand on k hits of each query by batches, and by expressions little more than a bound lets through; results agree."""
    from tidevec.operators import search

    monkeypatch.setattr(search, "SAMPLE_VECTORS", 200)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(4_000, 3)))], SLOTTED).repartition(3)
    queries = df.where("id % 500 = 0").selectExpr("id AS qid", "vec")
    out = [sorted(map(tuple, f(df, queries, 4, metric, 3).collect())) for f in (knn, knn_arrow)]
    assert out[0] == out[1] and len(out[0]) == 8 * 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, knn_arrow(df, queries, 4, metric, 3).collect())) == out[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_followed_stream(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    index = VectorIndex(spark, 2, mode="arrow").follow(target)
    assert index.is_empty()
    for part in ([(7, [1.0, 0.0])], [(9, [1.0, 1.0]), (8, [0.0, 1.0])]):
        spark.createDataFrame(part, VECS).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(VECS).parquet(source), target, state, 2).awaitTermination()
        assert index.search(part[-1][1], 1).first().id == part[-1][0]
    assert [tuple(r) for r in index.ids().collect()] == [(0, 7), (1, 8), (2, 9)]
    with pytest.raises(CapacityExceeded):
        index.add(1, [0.0, 0.0])


def test_describe(spark):
    index = VectorIndex(spark, 2, "ip")
    with pytest.raises(EmptyIndex):
        index.cache()
    row = index.append(spark.createDataFrame([(1, [1.0, 0.0])], VECS)).cache().describe().first()
    assert (row.vectors, row.bytes, row.mib, row.metric, row.mode) == (1, 16, 0, "ip", "sql") and row.executors >= 1 and row.cores >= 1
    index.close()
    with pytest.raises(NotInitialised):
        index.describe()
