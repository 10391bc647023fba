"""Append-only vector index over a DataFrame, with capacity, fixed dimension and metric."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidevec.errors import CapacityExceeded, EmptyIndex, NotInitialised, WrongDimension
from tidevec.functions.scores import METRICS, checked
from tidevec.operators.placement import cold_boot_budget_ms
from tidevec.operators.search import check_k, knn, knn_arrow, top_k
from tidevec.schemas import HITS, VECTORS
from tidevec.sources import corpus
from tidevec.sources.appended import appended


_ROW_BITS = 33


def with_slots(rows: DataFrame, order: Sequence[str], base: int = 0) -> tuple[DataFrame, int, DataFrame]:
    """rows with slot: base and on, dense, in the given total order; their number; and what to unpersist when done.

    Rows are sorted by range in the one shuffle; each range's size sets where its slots begin, so no task sees
    all rows. A row's number in its range is the low part of monotonically_increasing_id().
    """
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).persist()
    part = F.shiftright("_at", _ROW_BITS)
    sizes = {r["part"]: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}
    starts, total = {}, base
    for k in sorted(sizes):
        starts[k] = total
        total += sizes[k]
    start = F.create_map(*(F.lit(x).cast("long") for pair in (starts or {0: base}).items() for x in pair))
    slot = F.element_at(start, part.cast("long")) + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ranged.withColumn("slot", slot.cast("long")).drop("_at"), total - base, ranged


class VectorIndex:
    """Vectors (slot, id, vec) in append order.

    mode "sql" searches by expressions, "arrow" batches by numpy; results are the same. If "arrow" is asked
    for and numpy or pyarrow is missing, or a search by it fails, the index goes on in "sql" mode and
    fast_path_missing is True. Ids need not be unique or ordered. A second init() empties the index.
    """

    def __init__(self, spark: SparkSession, dim: int, metric: str = "l2", capacity: int | None = None, mode: str = "sql"):
        if dim <= 0 or capacity is not None and capacity <= 0:
            raise WrongDimension("dim and capacity are positive")
        self.spark, self.dim, self.capacity = spark, dim, capacity
        self._vectors: DataFrame | None = None
        self._kept: list[DataFrame] = []
        self._path: str | None = None
        self.init(metric, mode)

    def init(self, metric: str = "l2", mode: str = "sql") -> VectorIndex:
        """Empty the index and set metric and mode."""
        if metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
        self.metric, self.fast_path_missing, self.mode = metric, False, "sql"
        if mode == "arrow":
            try:
                import numpy  # noqa: F401
                import pyarrow  # noqa: F401

                self.mode = "arrow"
            except ImportError:
                self.fast_path_missing = True
        self._release()
        self._vectors, self._count = self.spark.createDataFrame([], VECTORS), 0
        return self

    def _release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        self._path = None

    def close(self) -> None:
        """Drop the vectors and what is kept of them; further calls raise NotInitialised until init()."""
        self._release()
        self._vectors = None

    def follow(self, path: str) -> VectorIndex:
        """Hold the vectors that append_stream() writes to path: every call sees what has arrived by then."""
        _ = self.vectors
        self._release()
        self._path = path
        return self

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            raise NotInitialised("init() the index first")
        return self._vectors if self._path is None else appended(self.spark, self._path)

    def append(self, rows: DataFrame, order: Sequence[str] = ("id",)) -> VectorIndex:
        """Add rows(id, vec) after those there, in the given order; over the capacity, as many as fit, then CapacityExceeded."""
        if self._path is not None:
            raise CapacityExceeded("the index follows a stream, which alone appends to it")
        base, known = self.count(), self.vectors
        new = rows.select("id", checked(F.col("vec").cast("array<float>"), self.dim).alias("vec"), *(c for c in order if c not in ("id", "vec")))
        slotted, n, kept = with_slots(new, order, base)
        self._kept.append(kept)
        room = n if self.capacity is None else max(0, self.capacity - base)
        self._vectors, self._count = known.unionByName(slotted.select("slot", "id", "vec").where(F.col("slot") < base + room)), base + min(n, room)
        if n > room:
            raise CapacityExceeded(f"{n - room} rows over the capacity of {self.capacity}", kept=room)
        return self

    def add(self, id_: int, vec: Sequence[float]) -> VectorIndex:
        """Add one vector."""
        if vec is None or len(vec) != self.dim:
            raise WrongDimension(f"expected {self.dim} elements")
        return self.append(self.spark.createDataFrame([(id_, [float(x) for x in vec])], "id BIGINT, vec ARRAY<FLOAT>"))

    def count(self) -> int:
        vectors = self.vectors
        return self._count if self._path is None else vectors.count()

    def is_empty(self) -> bool:
        return self.count() == 0

    def ids(self) -> DataFrame:
        """slot and id in append order."""
        return self.vectors.select("slot", "id").orderBy("slot")

    def data(self) -> DataFrame:
        """slot, dimension and value of each element, in append order."""
        return self.vectors.select("slot", F.posexplode("vec").alias("dimension", "value")).orderBy("slot", "dimension")

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """rank, id, score, slot of the k nearest vectors."""
        n = self.count()
        if query is None or len(query) != self.dim:
            raise WrongDimension(f"expected {self.dim} elements")
        check_k(k, n)
        if k == 0:
            return self.spark.createDataFrame([], HITS)
        if self.mode == "arrow":
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid BIGINT, vec ARRAY<FLOAT>")
            rows = self._fast(lambda: knn_arrow(self.vectors, one, k, self.metric, self.dim).select("rank", "id", "score", "slot").orderBy("rank").collect())
            if rows is not None:
                return self.spark.createDataFrame(rows, HITS)
        return top_k(self.vectors, query, k, self.metric, n)

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, rank, id, score, slot for each row of queries(qid, vec)."""
        check_k(k, self.count())
        if self.mode == "arrow":  # the result may be large, so what is tried at once is one query
            one = queries.limit(1)
            self._fast(lambda: knn_arrow(self.vectors, one, 1, self.metric, self.dim).collect())
        return (knn_arrow if self.mode == "arrow" else knn)(self.vectors, queries, k, self.metric, self.dim)

    def _fast(self, run: Callable[[], list]) -> list | None:
        """What run() gives; if it fails the index goes on in "sql" mode, which tells wrong input by its own errors."""
        try:
            return run()
        except (PySparkException, Py4JError, WrongDimension):
            self.mode, self.fast_path_missing = "sql", True
            return None

    def cache(self) -> VectorIndex:
        """Keep the vectors in executors' memory for further searches; describe() tells their size."""
        if self.is_empty():
            raise EmptyIndex("nothing to cache")
        self._kept.append(self.vectors.persist())
        return self

    def uncache(self) -> VectorIndex:
        self.vectors.unpersist()
        return self

    def _mib(self, n: int) -> int:
        return n * (self.dim * 4 + 8) >> 20

    def describe(self) -> DataFrame:
        """One row: what the index holds, how it searches, and what the session offers for it."""
        sc, n = self.spark.sparkContext, self.count()
        executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - (0 if sc.master.startswith("local[") else 1))
        row = (n, self.dim, n * (self.dim * 4 + 8), self._mib(n), self.metric, self.mode, self.fast_path_missing, executors, sc.defaultParallelism, self.vectors.rdd.getNumPartitions())
        return self.spark.createDataFrame([row], "vectors BIGINT, dim INT, bytes BIGINT, mib BIGINT, metric STRING, mode STRING, fast_path_missing BOOLEAN, executors INT, cores INT, partitions INT")

    def load_budget_ms(self) -> int:
        """Predicted time to load the vectors onto an accelerator; 0 in "sql" mode."""
        return 0 if self.mode == "sql" else cold_boot_budget_ms(self._mib(self.count()))

    def save(self, path: str) -> None:
        """Write the vectors as a corpus; dim and metric go along."""
        if self.is_empty():
            raise EmptyIndex("nothing to save")
        corpus.save(self.vectors, path, self.metric)

    def load(self, path: str) -> VectorIndex:
        """Append all rows of a corpus in record order; over the capacity, as many as fit, then CapacityExceeded."""
        rows = corpus.rows(self.spark, path)
        return self.append(rows, order=("run_id", "sequence", "row"))
