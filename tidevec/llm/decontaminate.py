"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows, scanned over documents.

Normalised words: ASCII letters lower-cased, then runs of ASCII letters and digits and non-ASCII
characters. A window is WINDOW consecutive words of an item, or the whole of a shorter item. Hits are
confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidevec.llm.common import WORDS, Scratch, as_bytes, cut, join_few, numbered, only, place_of, prepare, record_batch, runs, type_of, window_hashes

WINDOW = 8
#: Bytes of benchmark (texts, ids, and ROW_BYTES for each row) whose windows are one broadcast table, which
#: takes about six times that; a larger benchmark goes in blocks of this.
BLOCK_BYTES, ROW_BYTES = 8_000_000, 100

#: What is not part of a word becomes a space; A-Z becomes a-z.
NORMAL = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Windows:
    """The windows of some items as flat arrays, about five bytes for each byte of their texts.

    For each length of window: sorted hashes (keys) with item and place of each, and a sieve of their upper
    bits. A place is an offset into text, which holds the items' normalised words, joined by single spaces.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        found: dict = defaultdict(list)
        self.items, texts, at = [], [], 0
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            k = min(window, len(words))
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            keys = window_hashes(WORDS.array(words), k)
            starts = np.concatenate(([0], ends[: len(words) - k]))
            found[k].append((keys, np.full(len(keys), len(self.items), np.int32), at + starts, (ends[k - 1 :] - 1 - starts).astype(np.int32)))
            texts.append(b" ".join(words) + b" ")
            self.items.append(item)
            at += int(ends[-1])
        self.text = b"".join(texts)
        self.by_length = {}
        for k, parts in found.items():
            keys, item, start, size = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = min(max(int(8 * len(keys)).bit_length(), 10), 24)
            sieve = np.zeros(1 << bits, bool)
            sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_length[k] = (keys, item[order], start[order], size[order], sieve, np.uint64(64 - bits))

    def nbytes(self) -> int:
        return len(self.text) + sum(sum(x.nbytes for x in arrays) for arrays in self.by_length.values())

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in a window's occurrence, and the items whose windows occur."""
        n, names = len(words), set()
        mask = np.zeros(n, bool)
        if not n:
            return mask, names
        h = WORDS.array(words)
        for k, (keys, item, start, size, sieve, shift) in self.by_length.items():
            if k > n:
                continue
            w = window_hashes(h, k)
            at = np.flatnonzero(sieve[(w >> shift).astype(np.int64)])
            if not len(at):
                continue
            first, last = np.searchsorted(keys, w[at]), np.searchsorted(keys, w[at], side="right")
            met: dict = {}
            for i, a, b in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist()):
                joined = b" ".join(words[i : i + k])
                if (a, joined) not in met:  # the words decide, the hash only finds them
                    same = [j for j in range(a, b) if size[j] == len(joined) and self.text[start[j] : start[j] + size[j]] == joined]
                    names.update(self.items[x] for x in set(item[same].tolist()))
                    met[a, joined] = bool(same)
                if met[a, joined]:
                    mask[i : i + k] = True
        return mask, names


def without_spans(text: bytes, mask: np.ndarray) -> str:
    """text without the stretches from the first to the last word of each hit run."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for a, b in runs(mask):
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]]).decode("utf-8", "replace")


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """benchmark in parts of about block_bytes (texts, ids and an allowance for each row); a row's part is a hash of both."""
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + ROW_BYTES)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _scan(docs: DataFrame, text_at: int, id_at: int, benchmark: DataFrame, window: int, block_bytes: int, finish: Callable, schema: str | StructType) -> DataFrame:
    """finish(batch of docs, masks, items) of every batch, after all windows have been looked for.

    masks: packed bits, a bit for each word, null if no word is hit; items: sorted names of the items with
    occurring windows. A null text has no words. Benchmark rows with a null id or text are left out. A benchmark
    of one block is one pass over docs. With more, each block is a pass that keeps only ids, masks and items of
    the documents hit; these then join the documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = _blocks(benchmark, block_bytes)

    def table_of(block: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(Windows([(r.item, bytes(r.text)) for r in block.collect()], window))

    def found_in(batch: pa.RecordBatch, at: int, windows: Windows) -> tuple[list, list]:
        masks, names = [], []
        for text in as_bytes(batch.column(at)):
            mask, found = windows.hits(normal_words(text))
            masks.append(np.packbits(mask).tobytes() if found else None)
            names.append(sorted(found) if found else None)
        return masks, names

    if len(blocks) == 1:
        table = table_of(blocks[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield finish(b, *found_in(b, text_at, table.value))

        return docs.mapInArrow(run, schema)

    scratch, text = Scratch(spark), F.col(docs.columns[text_at])
    marked = docs.withColumns({"_doc": F.coalesce(F.concat(F.lit("="), F.col(docs.columns[id_at]).cast("string")), F.lit("")), "_twin": F.xxhash64(text)})
    hit = []
    for block in blocks:
        table = table_of(block)

        def look(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for b in batches:
                masks, names = found_in(b, 2, table.value)
                rows = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["_doc", "_twin", "_mask", "_items"])
                yield rows.filter(pa.compute.is_valid(rows.column(2)))

        looked = marked.select("_doc", "_twin", text).mapInArrow(look, "_doc string, _twin long, _mask binary, _items array<string>")
        hit.append(scratch.keep(looked.groupBy("_doc", "_twin").agg(F.first("_mask").alias("_mask"), F.first("_items").alias("_items"))))
        table.destroy()
    merged = reduce(DataFrame.union, hit).groupBy("_doc", "_twin").agg(F.collect_list(F.struct("_mask", "_items")).alias("_hits"))
    merged = cut(merged)
    scratch.close()
    number, held = merged.agg(F.count(F.lit(1)), F.sum(F.expr("aggregate(_hits, 0L, (a, x) -> a + octet_length(x._mask) + 40 * size(x._items) + 40)"))).first()
    joined = join_few(marked, merged, ["_doc", "_twin"], "left", number, 60 + (held or 0) // max(number, 1)).select(*docs.columns, "_hits")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, names = [], []
            for hits in b.column(b.num_columns - 1).to_pylist():
                masks.append(reduce(np.bitwise_or, (np.frombuffer(x["_mask"], np.uint8) for x in hits)).tobytes() if hits else None)
                names.append(sorted({i for x in hits for i in x["_items"]}) if hits else None)
            yield finish(pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]), masks, names)

    return joined.mapInArrow(combine, schema)


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs(doc_id, text, ...).

    Null or empty texts have 0 words and no items (the digest of no items is that of the empty string).
    Repeated rows and null ids give a row each; other columns of docs are not read.
    """

    def finish(b: pa.RecordBatch, masks: list, names: list) -> pa.RecordBatch:
        words = [len(normal_words(x)) for x in as_bytes(b.column(1))]
        hit = [int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if m else 0 for m in masks]
        items = [x or [] for x in names]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        many = [len(x) for x in items]
        return record_batch(
            doc_id=b.column(0),
            n_words=(words, pa.int64()),
            n_hit=(hit, pa.int64()),
            n_items=(many, pa.int64()),
            items_sha256=(digests, pa.string()),
            contaminated=([n >= min_items for n in many], pa.bool_()),
        )

    schema = f"doc_id {type_of(docs, 'doc_id')}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _scan(only(docs, "doc_id", "text"), 1, 0, benchmark, window, block_bytes, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold windows of min_items items or more, and without the hit spans of the others.

    A document whose words are all hit goes as well. Untouched rows come back as they are, nulls and extra
    columns (of whatever name) included; repeated rows are treated alike.
    """
    names_, docs, text_at, id_at = docs.columns, numbered(docs), place_of(docs, "text"), place_of(docs, "doc_id")

    def finish(b: pa.RecordBatch, masks: list, names: list) -> pa.RecordBatch:
        texts, keep = b.column(text_at).to_pylist(), []
        for j, (m, items) in enumerate(zip(masks, names)):
            keep.append(len(items or ()) < min_items)
            if m is not None and keep[-1]:
                raw = texts[j].encode()
                mask = np.unpackbits(np.frombuffer(m, np.uint8), count=len(normal_words(raw))).astype(bool)
                texts[j] = without_spans(raw, mask)
                keep[-1] = not mask.all()
        columns = [*b.columns]
        columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, text_at, id_at, benchmark, window, block_bytes, finish, docs.schema).toDF(*names_)
