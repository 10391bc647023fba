"""Exact substring dedup with a count-min prefilter.

A word is removed if a window of WINDOW words that covers it has a word sequence that also starts earlier:
in a document of smaller doc_id, or before in the same document.

1. Anchors. A window's anchor is the least-hash ANCHOR-word gram in it (the leftmost of equals). Equal
   windows have equal anchors at equal places, so a window is repeated only if its anchor gram is selected
   at two places or more. Anchors are about a sixth of all grams; they are kept in the shared folder.
2. Sketch. Each flush (some megabytes of text) counts its anchors in a count-min sketch of DEPTH rows and sends
   it in sparse form, by range of cells. Ranges are merged where they meet, and each flush is told which of its
   cells have a merged count of two or more: counts can only be too high. Ranges grow in number with the
   corpus, so no task, and not the driver, ever holds the whole sketch.
3. Windows. A second pass reads the documents with such anchors and sends, of each window of one, the first
   occurrence of each flush to the task of its hash range; there exact groups (by 128 bits) find the earliest
   occurrence of each window. Later occurrences in the same flush are known to be removed at once.
4. What is to be removed goes to the task of its document's hash range and comes back as a row a document.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import WORDS, Scratch, as_bytes, cover, cut, join_few, mix, numbered, only, place_of, prepare, record_batch, runs, type_of, window_hashes

WINDOW, ANCHOR = 20, 10
#: Rows of the sketch; anchors that one merge is meant to see, and cells of its range: about 32 for each, so one
#: that occurs once is taken for repeated with probability (1/32)**2. Ranges are as many as the corpus needs.
DEPTH, RANGE_ANCHORS, RANGE_CELLS, LEAST_RANGES = 2, 1_000_000, 1 << 25, 8
#: Anchors of the corpus for each exact group of windows (few of them are repeated).
GROUP_ANCHORS = 500_000
#: Bytes of text after which a task sends what it has gathered.
FLUSH_BYTES = 8_000_000

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NONE = np.empty(0, np.int64)


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's place, and the hashes of all grams. Needs at least window words."""
    g = window_hashes(h, anchor)
    span = window - anchor + 1
    view = sliding_window_view(g, span)
    at = np.empty(len(view), np.int64)
    for i in range(0, len(view), 1 << 16):
        at[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(1)
    return at + np.arange(len(view)), g


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def anchor_store(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """flush, n, docs, hashes, places: the anchors of about FLUSH_BYTES of text a row, of docs(_doc, _twin, text); kept in scratch.

    docs: id, text hash and number of anchors of each document; hashes and places: those of all their anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            doc, twin = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            n = np.array([len(r[2]) for r in rows], np.int64)
            hashes, places = np.concatenate([np.empty(0, np.uint64), *(r[2] for r in rows)]), np.concatenate([_NONE, *(r[3] for r in rows)])
            columns = [uuid.uuid4().bytes], [len(hashes)], [_pack(doc, twin, n)], [hashes.tobytes()], [_pack(np.diff(places, prepend=0).astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["flush", "n", "docs", "hashes", "places"])

        for b in batches:
            for _, doc, twin, size, h in _long_enough(b):
                at, g = anchors(h)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                rows.append((doc, twin, g[at], at))
                held += size
                if held >= FLUSH_BYTES:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return scratch.keep(docs.mapInArrow(run, "flush binary, n long, docs binary, hashes binary, places binary"))


def _cells(hashes: bytes, row: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a flush, its distinct cells (range and cell in it, in order), how often each occurs, and each anchor's."""
    x = mix(np.frombuffer(hashes, np.uint64) + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15))
    cell = _groups(x, ranges) * RANGE_CELLS + (x & np.uint64(RANGE_CELLS - 1)).astype(np.int64)
    found, of, n = np.unique(cell, return_inverse=True, return_counts=True)
    return found, n, of


def merged_sketches(store: DataFrame, ranges: int) -> DataFrame:
    """flush, row, range, mask: for each cell that a flush has sent (in order), whether its count over all flushes is two or more.

    A range of cells is merged in a task of its own, and told to the flushes that sent to it: nobody needs the whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flush, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of, at, parts = [], [], []
                for row in range(DEPTH):
                    cell, n, _ = _cells(hashes, row, ranges)
                    r = cell // RANGE_CELLS
                    names, starts = np.unique(r, return_index=True)
                    for k, x, y in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(r)]):
                        of.append(row)
                        at.append(k)
                        parts.append(_pack(np.diff(cell[x:y] % RANGE_CELLS, prepend=0).astype(np.uint32), n[x:y] > 1))
                yield record_batch(flush=([flush] * len(of), pa.binary()), row=(of, pa.int32()), range=(at, pa.int64()), part=(parts, pa.binary()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        cells, counts, ends = [], [], [0]
        for part in t.column("part").to_pylist():
            raw = zstandard.decompress(part)
            n = len(raw) // 5
            cells.append(np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.uint32))
            counts.append(1 + np.frombuffer(raw, np.uint8, n, 4 * n))
            ends.append(ends[-1] + n)
        _, of = np.unique(np.concatenate(cells), return_inverse=True)
        many = (np.bincount(of, np.concatenate(counts)) >= 2)[of]
        masks = [np.packbits(many[x:y]).tobytes() for x, y in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("flush", "row", "range")), pa.array(masks, pa.binary())], ["flush", "row", "range", "mask"])

    sent = store.select("flush", "hashes").mapInArrow(count, "flush binary, row int, range long, part binary")
    return sent.groupBy("row", "range").applyInArrow(merge, "flush binary, row int, range long, mask binary")


def estimated(store: DataFrame, ranges: int) -> DataFrame:
    """_doc, _twin, n, starts: a row for each document with anchors estimated to occur twice or more, and their packed places."""
    masks = merged_sketches(store, ranges).groupBy("flush").agg(F.sort_array(F.collect_list(F.struct("row", "range", "mask"))).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, hashes, places, masks in zip(*(c.to_pylist() for c in b.columns)):
                raw, n = zstandard.decompress(docs), len(hashes) // 8
                doc, twin, each = np.frombuffer(raw, np.int64).reshape(3, -1)
                place = np.cumsum(np.frombuffer(zstandard.decompress(places), np.int32), dtype=np.int64)
                ok = np.ones(n, bool)
                for row in range(DEPTH):
                    cell, _, of = _cells(hashes, row, ranges)
                    sent = np.unique(cell // RANGE_CELLS, return_counts=True)[1]
                    told = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=k) for m, k in zip((m for m in masks if m["row"] == row), sent.tolist(), strict=True)]
                    ok &= np.concatenate(told).astype(bool)[of]
                at = np.flatnonzero(ok)
                found = _by_document(np.repeat(doc, each)[at], np.repeat(twin, each)[at], place[at])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.binary()))], ["_doc", "_twin", "starts"])

    told = store.select("flush", "docs", "hashes", "places").join(masks, "flush").select("docs", "hashes", "places", "masks")
    return told.mapInArrow(run, "_doc long, _twin long, starts binary").groupBy("_doc", "_twin").agg(F.first("starts").alias("starts"))


def _earliest(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows later than the first of their window (both hashes), and the first row of each window.

    First is the least document (id, text hash) and place. Equal (document, place) are the same place, given by
    repeated rows: none of them is later than the other.
    """
    if not len(h):
        return _NONE, _NONE
    order = np.lexsort((at, twin, doc, h2, h))
    h, h2, doc, twin, at = h[order], h2[order], doc[order], twin[order], at[order]
    start = np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    return order[(doc != doc[first]) | (twin != twin[first]) | (at != at[first])], order[start]


def _by_document(doc: np.ndarray, twin: np.ndarray, at: np.ndarray) -> tuple[list, list, list]:
    """Distinct window starts as one row for each document, packed."""
    order = np.lexsort((at, twin, doc))
    doc, twin, at = doc[order], twin[order], at[order]
    ends = np.flatnonzero(np.concatenate(((doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]), [True]))) + 1 if len(doc) else _NONE
    docs, twins, packed, a = [], [], [], 0
    for b in ends.tolist():
        docs.append(int(doc[a]))
        twins.append(int(twin[a]))
        packed.append(_pack(np.diff(np.unique(at[a:b]), prepend=0).astype(np.uint32)))
        a = b
    return docs, twins, packed


def _parts(group: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Groups that occur, and the packed columns of each. Documents are the last three columns: id, text hash, place."""
    order = np.argsort(group, kind="stable")
    found, starts = np.unique(group[order], return_index=True)
    packed = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        at = order[a:b]
        packed.append(_pack(np.array([b - a], np.int64), *(c[at].astype(np.uint32) if i == len(columns) - 1 else c[at] for i, c in enumerate(columns))))
    return found.tolist(), packed


def _unpack(parts: list[bytes], hashed: bool) -> tuple[np.ndarray, ...]:
    """(both window hashes,) document id, text hash and place of all rows in parts."""
    types = [*([np.uint64, np.uint64] if hashed else []), np.int64, np.int64, np.uint32]
    columns: list[list] = [[np.empty(0, t)] for t in types]
    for part in parts:
        raw = zstandard.decompress(part)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for column, t in zip(columns, types):
            column.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    *first, place = (np.concatenate(c) for c in columns)
    return (*first, place.astype(np.int64))


def _groups(h: np.ndarray, groups: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _homes(doc: np.ndarray, twin: np.ndarray, groups: int) -> np.ndarray:
    return _groups(mix(doc.view(np.uint64) ^ mix(twin.view(np.uint64))), groups)


def _located(docs: DataFrame, spread: Callable, shards: int) -> DataFrame:
    """_doc, _twin, starts: for each document the packed places of windows that occur earlier.

    spread gives, for a batch of docs, document id, text hash, bytes, and both hashes and places of the windows
    of each document. A task settles what its own rows tell and sends one row of each window to the task of
    the hash's range, so a common window is no hot group; what is found goes to the task of the document's range.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list] = [[], [], [], [], []]
        held = 0

        def out() -> pa.RecordBatch:
            h, h2, doc, twin, at = (np.concatenate([*x, np.empty(0, t)]) for x, t in zip(gathered, (np.uint64, np.uint64, np.int64, np.int64, np.int64)))
            here, first = _earliest(h, h2, doc, twin, at)
            homes, found = _parts(_homes(doc[here], twin[here], shards), doc[here], twin[here], at[here])
            of, sent = _parts(_groups(h[first], shards), h[first], h2[first], doc[first], twin[first], at[first])
            which = [True] * len(homes) + [False] * len(of)
            return record_batch(shard=([*homes, *of], pa.int64()), found=(which, pa.bool_()), part=([*found, *sent], pa.binary()))

        for b in batches:
            for doc, twin, size, h, h2, at in spread(b):
                held += size
                for x, y in zip(gathered, (h, h2, np.full(len(at), doc, np.int64), np.full(len(at), twin, np.int64), at)):
                    x.append(y)
                if held >= FLUSH_BYTES:
                    yield out()
                    gathered, held = [[], [], [], [], []], 0
        yield out()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], []]
        for b in batches:
            for found, part in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts[found].append(part)
        h, h2, doc, twin, at = _unpack(parts[0], True)
        here, _ = _earliest(h, h2, doc, twin, at)
        homes, found = _parts(_homes(doc[here], twin[here], shards), doc[here], twin[here], at[here])
        passed = [int(_homes(*x, shards)[0]) for x in ((d[:1], t[:1]) for d, t, _ in (_unpack([p], False) for p in parts[1]))]
        yield pa.RecordBatch.from_arrays([pa.array([*homes, *passed], pa.int64()), pa.array([*found, *parts[1]], pa.binary())], ["home", "part"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, twins, packed = _by_document(*_unpack([p for b in batches for p in b.column(1).to_pylist()], False))
        yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(twins, pa.int64()), pa.array(packed, pa.binary())], ["_doc", "_twin", "starts"])

    sent = docs.mapInArrow(emit, "shard long, found boolean, part binary")
    found = sent.groupBy("shard").applyInArrow(group, "home long, part binary")
    return found.groupBy("home").applyInArrow(gather, "_doc long, _twin long, starts binary")


def _long_enough(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Row, document id, text hash, bytes and word hashes of the texts of a batch that have a window."""
    for j, (doc, twin, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)))):
        words = text.split() if text else ()
        if len(words) >= WINDOW:
            yield j, doc, twin, len(text), WORDS.array(words)


def _windows(h: np.ndarray, at: np.ndarray, place: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes (128 bits) and the starts of the windows whose anchor, by first window of each anchor, is ok."""
    starts = np.flatnonzero(np.repeat(ok, np.diff(place, append=len(at))))
    return window_hashes(h, WINDOW)[starts], window_hashes(h, WINDOW, 0x51ED270B)[starts], starts


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_doc, _twin, starts: a row for each document that has windows to be removed, with their packed starts; kept in scratch.

    docs has _doc (doc_id, least long for null), _twin (hash of the text) and text.
    """
    docs = docs.select("_doc", "_twin", "text")
    store = anchor_store(docs, scratch)
    total = store.agg(F.sum("n")).first()[0] or 0
    found = scratch.keep(estimated(store, max(LEAST_RANGES, -(-total // RANGE_ANCHORS))), total // 4)
    scratch.drop(store)
    number, packed = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("starts"))).first()

    def by_places(b: pa.RecordBatch) -> Iterator[tuple]:
        places = b.column(3).to_pylist()
        for j, doc, twin, n, h in _long_enough(b):
            at, _ = anchors(h)
            place = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            yield doc, twin, n, *_windows(h, at, place, np.isin(at[place], _places(places[j])))

    read_on = join_few(docs, found, ["_doc", "_twin"], "inner", number, 24 + (packed or 0) // max(number, 1)).select("_doc", "_twin", "text", "starts")
    located = scratch.keep(_located(read_on, by_places, max(LEAST_RANGES, -(-total // GROUP_ANCHORS))), total // 4)
    scratch.drop(found)
    return located


def find_repeats(docs: DataFrame, own: list[str], doc_id: Column, text: Column) -> DataFrame:
    """The columns own of docs with _starts (packed starts of the windows to be removed; null if none)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    marked = docs.withColumns({"_doc": F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))), "_twin": F.xxhash64(text)})
    located = repeated_windows(marked.select("_doc", "_twin", text.alias("text")), scratch).withColumnRenamed("starts", "_starts")
    number, packed = located.agg(F.count(F.lit(1)), F.sum(F.octet_length("_starts"))).first()
    found = cut(located, 4 * number)
    scratch.close()
    return join_few(marked.select(*own, "_doc", "_twin"), found, ["_doc", "_twin"], "left", number, 24 + (packed or 0) // max(number, 1)).select(*own, "_starts")


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.uint32), dtype=np.int64)


def _mask(n: int, packed: bytes) -> np.ndarray:
    return cover(_places(packed), WINDOW, n)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text, ...).

    A null text has no words; its digest is that of the empty string. A null doc_id is smaller than all
    others. Rows of equal id and text are one document: their windows are not earlier than each other's,
    and both get the same result; rows of equal id and different text are told apart by a hash of the text.
    """
    kind, docs = type_of(docs, "doc_id"), only(docs, "doc_id", "text")
    found = find_repeats(docs, docs.columns, F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for text, packed in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                words = text.split() if text else []
                n.append(len(words))
                mask = _mask(len(words), packed) if packed else None
                gone.append(0 if mask is None else int(mask.sum()))
                kept = words if mask is None else [words[i] for i in np.flatnonzero(~mask).tolist()]
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of text, from the first to the last word of each run; rows left without words go.

    Untouched rows come back as they are, nulls and extra columns (of whatever name) included. Rows of equal id
    and text are one document, as in report().
    """
    names, docs, text_at, id_at = docs.columns, numbered(docs), place_of(docs, "text"), place_of(docs, "doc_id")
    found, schema = find_repeats(docs, docs.columns, F.col(f"c{id_at}"), F.col(f"c{text_at}")), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(text_at).to_pylist(), []
            for j, packed in enumerate(b.column(b.num_columns - 1).to_pylist()):
                keep.append(True)
                if packed:
                    raw = texts[j].encode()
                    at = [m.span() for m in WORD.finditer(raw)]
                    mask = _mask(len(at), packed)
                    out, end = [], 0
                    for x, y in runs(mask):
                        out.append(raw[end : at[x][0]])
                        end = at[y - 1][1]
                    texts[j] = b"".join([*out, raw[end:]]).decode("utf-8", "replace")
                    keep[-1] = not mask.all()
            columns = [*b.columns[:-1]]
            columns[text_at] = pa.array(texts, b.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(run, schema).toDF(*names)
