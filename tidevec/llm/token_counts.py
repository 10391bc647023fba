"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier 1 is a broadcast table of the lengths (in tokens) of frequent pre-tokens. Tier 2 is each worker's
own cache, filled by encoding what tier 1 misses. A pre-token here is a run between ASCII white space:
the tokenizers served drop white space, so no token and no special string crosses it, and the sum over
the runs is the count of the whole text.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import as_bytes, only, prepare, record_batch, type_of

#: Documents that the frequent table is drawn from. The table only saves time; counts never depend on it.
SAMPLE_DOCS = 2_000
#: Entries of the broadcast table (below 2 MB pickled), and tasks that draw its sample.
TABLE_ENTRIES, SAMPLE_PARTS = 65_536, 8
#: Entries of a worker's cache.
WORKER_ENTRIES = 500_000
#: Longer pre-tokens are encoded each time and kept nowhere.
LONGEST_KEPT = 64

_tokenizers: dict = {}


def load_tokenizer(path: str):
    """The library's tokenizer, one for each process, without truncation or padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


class Lengths(dict):
    """Both tiers of one worker: the broadcast table, and lengths of pre-tokens that it has encoded."""

    def __init__(self, path: str, table: dict[bytes, int]):
        super().__init__(table)
        self.tokenizer, self.most = load_tokenizer(path), len(table) + WORKER_ENTRIES

    def __missing__(self, word: bytes) -> int:
        n = len(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(word) <= LONGEST_KEPT and len(self) < self.most:
            self[word] = n
        return n


_workers: dict = {}


def _worker(path: str, table) -> Lengths:
    """The tables of this worker process: made once, kept from task to task."""
    if path not in _workers:
        _workers[path] = Lengths(path, table.value)
    return _workers[path]


def frequent(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """Lengths of frequent pre-tokens of at most about SAMPLE_DOCS documents, by hash of their ids.

    Each task counts on its own and hands over its commonest, as one value; the driver adds these up, of at
    most SAMPLE_PARTS tasks. No pre-token is shuffled.
    """
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in as_bytes(b.column(0)):
                seen.update(w for w in text.split() if len(w) <= LONGEST_KEPT)
        if seen:
            top = seen.most_common(entries // SAMPLE_PARTS)
            yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.binary())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["w", "n"])

    seen: Counter = Counter()
    for r in sample.select("text").coalesce(SAMPLE_PARTS).mapInArrow(count, "w array<binary>, n array<long>").toLocalIterator():
        for w, n in zip(r.w, r.n):
            seen[bytes(w)] += n
    words = sorted(seen, key=lambda w: (-seen[w], w))[:entries]
    lengths = load_tokenizer(path).encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, lengths, strict=True)}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text, ...).

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows and null ids give a row each. Other
    columns of docs are neither read nor returned. An empty table gives an empty result. Text of any
    length is counted whole; memory is bounded by one Arrow batch and the two tables.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind, docs = type_of(docs, "doc_id"), only(docs, "doc_id", "text")
    table = spark.sparkContext.broadcast(frequent(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = _worker(path, table).__getitem__
        for b in batches:
            size, tokens = [], []
            for text in as_bytes(b.column(1)):
                size.append(len(text or b""))
                tokens.append(sum(map(length, text.split())) if text else 0)
            over = [n > limit for n in tokens]
            yield record_batch(doc_id=b.column(0), n_bytes=(size, pa.int64()), n_tokens=(tokens, pa.int64()), over_limit=(over, pa.bool_()))

    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
