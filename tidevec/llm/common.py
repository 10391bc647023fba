"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch takes; texts are long, and some very long.
BATCH_ROWS, BATCH_BYTES = 512, "32m"
#: Bytes up to which a table of ids or of sites is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64_000_000
#: Python workers live on from stage to stage; so they give freed memory back at once.
WORKER_ENVIRONMENT = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_MMAP_THRESHOLD_": "1000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Small rows (ids, labels) that one part of a kept table is meant to hold.
PART_ROWS = 50_000
#: Entries of a worker's word cache (about 0.2 kB each).
CACHE_ENTRIES = 150_000


def prepare(spark: SparkSession) -> None:
    """Settings that every operator relies on: small Arrow batches, importable workers, a checkpoint folder.

    They stay set in the session: results are lazy and need them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    env |= WORKER_ENVIRONMENT
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, on one machine else one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", "tidevec")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, computed once and checkpointed: for tables that a lazy result still reads. rows as in Scratch.keep()."""
    prepare(df.sparkSession)
    return (df if rows is None else in_few_parts(df, rows)).checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own in the shared one, for steps whose results nothing lazy reads."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/tidevec-{uuid.uuid4()}", {}

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The same rows, written once and read back; if they are at most `rows` small ones, in no more files than that needs."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        (df if rows is None else in_few_parts(df, rows)).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def add(self, kept: DataFrame, df: DataFrame) -> DataFrame:
        """A table that keep() gave with the rows of df added to it, in its place."""
        path, _ = self.paths.pop(id(kept))
        df.write.mode("append").parquet(path)
        longer = self.spark.read.schema(kept.schema).parquet(path)
        self.paths[id(longer)] = (path, longer)
        return longer

    def part(self, kept: DataFrame, *names: str) -> DataFrame:
        """Some columns of a table that keep() gave, in its place."""
        path, _ = self.paths.pop(id(kept))
        selected = kept.select(*names)
        self.paths[id(selected)] = (path, selected)
        return selected

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() gave."""
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[0])

    def close(self) -> None:
        """Delete all that is left."""
        self.paths.clear()
        delete(self.spark, self.folder)


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """df in as many parts as so many small rows need, if it has more: every file costs the stores and executors something."""
    return df.coalesce(rows // PART_ROWS + 1)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows of row_bytes take no more than BROADCAST_BYTES; beyond that the join shuffles."""
    return F.broadcast(df) if rows * (row_bytes + 32) <= BROADCAST_BYTES else df


#: Entries of a sieve (64 bits each), which bounds the table that join_few() broadcasts.
SIEVE = 1 << 20


def join_few(docs: DataFrame, few: DataFrame, on: list[str], how: str, rows: int, row_bytes: int) -> DataFrame:
    """docs joined with few (distinct in on; how: inner, left or left_anti), most of docs not being in it.

    A small table is broadcast. Beyond that a sieve of its keys is (at most SIEVE rows): what it lets through is
    joined by shuffle, and the rest of docs, which few cannot hold, stays where it is.
    """
    if rows * (row_bytes + 32) <= BROADCAST_BYTES:
        return docs.join(F.broadcast(few), on, how)
    entry, bit = F.pmod(F.xxhash64(*on), F.lit(SIEVE)), F.pmod(F.shiftright(F.xxhash64(*on), 32), F.lit(64)).cast("int")
    keys = few.select(entry.alias("_entry"), bit.alias("_bit")).groupBy("_entry").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    marked = docs.withColumns({"_entry": entry, "_bit": bit}).join(F.broadcast(keys), "_entry", "left")
    through = F.expr("coalesce(shiftright(_bits, _bit) & 1L, 0L) = 1L")
    found = marked.where(through).select(*docs.columns).join(few, on, how)
    if how == "inner":
        return found
    extra = [f.dataType for f in few.schema if f.name not in on] if how == "left" else []
    rest = marked.where(~through).select(*docs.columns)
    for name, kind in zip([c for c in few.columns if c not in on], extra):
        rest = rest.withColumn(name, F.lit(None).cast(kind))
    return found.unionByName(rest)


def place_of(docs: DataFrame, name: str) -> int:
    """Place of the column called name; of several that differ in case only, the one written alike."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(docs.columns):
            if same(c):
                return i
    raise ValueError(f"there is no column {name}")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: no working column (named _...) clashes with them, whatever they were called."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, under these names; others, of whatever name, are not read."""
    plain = numbered(docs)
    return plain.select(*(F.col(f"c{place_of(docs, n)}").alias(n) for n in names))


def type_of(docs: DataFrame, name: str) -> str:
    """The type of a column as in a schema string."""
    return docs.schema[place_of(docs, name)].dataType.simpleString()


def is_training(doc_id: Column) -> Column:
    """Fold rule: crc32 of the id as text, modulo 5, is not 0. A null id is in no fold to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


class WordHash(dict):
    """64-bit hashes of words (bytes), cached up to CACHE_ENTRIES words of at most 64 bytes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64 and len(self) < CACHE_ENTRIES:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for each worker process.
WORDS = WordHash()


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, in order of the run's start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing permutation of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Boolean mask of n places covered by runs of k that begin at starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:n]) > 0


def record_batch(**columns: pa.Array | tuple) -> pa.RecordBatch:
    """A batch of these columns: arrays, or (values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(*c) if isinstance(c, tuple) else c for c in columns.values()], names=list(columns))


def as_bytes(column: pa.Array) -> list:
    """A string column as bytes objects (None for null), without decoding."""
    return column.cast(pa.binary()).to_pylist()
