"""Packing of token sequences: best fit, then swap-based local search, over the histogram of piece lengths.

Documents move one by one, one for one or two for one between underfull bins as long as the sum of squared
fills grows; where nothing gains, sideways exchanges that open a gaining chain are looked for.

Lengths are integers up to the capacity, so bins of equal contents are one entry with a count, and a
packing of any number of pieces is planned on the driver from a histogram of at most `capacity` entries.
Pieces are then matched to planned places by their rank among pieces of equal length.
"""

from __future__ import annotations

import base64
import json
import os
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidevec.llm.common import cut, only, prepare, record_batch, type_of
from tidevec.llm.token_counts import load_tokenizer

CAPACITY, END_ID = 1024, 2
#: Entries of a worker's cache of chunks, for each of two kinds.
CHUNK_ENTRIES, LONGEST_KEPT = 150_000, 64
#: Characters of a plain text that is encoded at once, which bounds memory; longer ones go in chunks.
LONGEST_WHOLE = 1 << 20
#: Pieces of one length that are ranked together; a commoner length is dealt to several parts by a hash of the row.
PART_ROWS = 100_000
#: Fruitless sideways exchanges in a row, and exchanges in all (each in all bins of equal contents at once),
#: after which the local search ends. They bound its effort, not what it looks at: every underfull bin is tried.
PATIENCE, MOST_EXCHANGES = 4_000, 20_000

#: Plain text, on which the fast encoder and the library split alike; other chunks go to the library.
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ɏ]+")
ODD_SPACE = re.compile(r"[ \n]\s|\s[ \n]")
BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


class Chunks(dict):
    """Ids (little-endian 32 bits) of text chunks after a fixed prefix."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(self.prefix + chunk), "<u4").tobytes()
        if len(chunk) <= LONGEST_KEPT and len(self) < CHUNK_ENTRIES:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts as the library's byte-level tokenizer gives them, from cached chunks.

    A single space or line feed between other than white space always begins a pre-token, so texts are cut
    there. ranks_path names the same vocabulary for the faster encoder, which takes plain texts whole; without
    it the library does all.
    """

    def __init__(self, path: str, ranks_path: str | None):
        # The library's tokenizer takes over 100 MB; most workers never need it.
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks_path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.after_space, self.feed = Chunks(self.ids, ""), Chunks(self.ids, " "), np.array(self.ids("\n"), "<u4").tobytes()

    def slow(self, text: str) -> list[int]:
        return load_tokenizer(self.path).encode(text, add_special_tokens=False).ids

    def ids(self, chunk: str) -> list[int]:
        if not chunk:
            return []
        return self.fast.encode_ordinary(chunk) if self.fast and PLAIN.fullmatch(chunk) else self.slow(chunk)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.slow(text), "<u4").tobytes()
        if self.fast and len(text) <= LONGEST_WHOLE and PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        if ODD_SPACE.search(text):
            return b"".join(map(self.first.__getitem__, BEFORE_WORD.split(text)))
        out, after = [], self.after_space.__getitem__
        for line in text.split("\n"):
            chunks = line.split(" ")
            out.append(self.first[chunks[0]] + b"".join(map(after, chunks[1:])))
        return self.feed.join(out)


_encoders: dict = {}


def encoder(path: str, ranks_path: str | None) -> Encoder:
    """One for each worker process."""
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def pieces(docs: DataFrame, path: str, ranks_path: str | None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut so that all but the first piece are full."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path).encode
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(memoryview(ids)[4 * x : 4 * y]))
            doc_id = b.column(0).take(pa.array(row, pa.int64()))
            yield record_batch(doc_id=doc_id, piece=(piece, pa.int32()), start=(start, pa.int64()), length=(length, pa.int64()), ids_crc32=(crc, pa.int64()))

    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (contents, number of such bins): longest pieces first, each into the fullest bins that take it."""
    open_: dict[int, list] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if open_.get(r)), None)
            contents, bins = open_[room].pop() if room is not None else ((), left)
            room = capacity if room is None else room
            each = room // length
            used, rest = min(bins, left // each), left % each
            if used:
                open_[room - each * length].append((contents + (length,) * each, used))
                left -= used * each
                bins -= used
            if bins and 0 < left < each:
                open_[room - rest * length].append((contents + (length,) * rest, 1))
                left, bins = 0, bins - 1
            if bins and contents:
                open_[room].append((contents, bins))
    return [x for group in open_.values() for x in group]


class _Entries:
    """What bins can give: rows of value, kind (0 nothing, 1 a piece, 2 two pieces), room and class; a dead class is -1."""

    def __init__(self):
        self.rows, self.used = np.full((4, 1024), -1, np.int64), 0

    def add(self, number: int, room: int, contents: tuple) -> None:
        ones, twos = sorted(set(contents)), sorted({x + y for x, y in combinations(contents, 2)}) if room else []
        n = 1 + len(ones) + len(twos)
        if self.used + n > self.rows.shape[1]:
            live = self.rows[:, : self.used]
            live = live[:, live[3] >= 0]
            self.rows = np.full((4, 2 * (live.shape[1] + n) + 1024), -1, np.int64)
            self.rows[:, : live.shape[1]], self.used = live, live.shape[1]
        at = self.rows[:, self.used : self.used + n]
        at[0], at[1], at[2], at[3] = [0, *ones, *twos], [0] + [1] * len(ones) + [2] * len(twos), room, number
        self.used += n

    def drop(self, number: int) -> None:
        classes = self.rows[3, : self.used]
        classes[classes == number] = -1

    def live(self) -> np.ndarray:
        return self.rows[:, : self.used]


def _moved(contents: tuple, out: tuple, into: tuple) -> tuple:
    rest = list(contents)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into], reverse=True))


class LocalSearch:
    """Exchanges between underfull bins; bins of equal contents are one class with a count."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]], capacity: int, seed: int = 1):
        self.capacity, self.random = capacity, random.Random(seed)
        self.count: dict[tuple, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.names: list[tuple] = []
        self.under, self.full = _Entries(), _Entries()
        self.changed: list[tuple] = []
        self.log: list | None = None
        self.bins = self.exchanges = 0
        for contents, n in sorted((tuple(sorted(c, reverse=True)), n) for c, n in bins):
            self.change(contents, n)
        self.least = -(-sum(sum(c) * n for c, n in self.count.items()) // capacity)

    def change(self, contents: tuple, n: int) -> None:
        """n more (or fewer) bins of these contents; empty bins vanish."""
        if not contents or not n:
            return
        if self.log is not None:
            self.log.append((contents, n))
        was, room = self.count.get(contents, 0), self.capacity - sum(contents)
        entries = self.under if room else self.full
        self.bins += n
        self.count[contents] = was + n
        if not was:
            self.numbers[contents] = len(self.names)
            self.names.append(contents)
            entries.add(self.numbers[contents], room, contents)
        if room and was + n:
            self.changed.append(contents)
        if not was + n:
            del self.count[contents]
            entries.drop(self.numbers.pop(contents))

    def exchange(self, giver: tuple, taker: tuple, given: tuple, back: tuple) -> None:
        """given goes from giver to taker and back the other way, in as many bins of the two classes as can be paired."""
        n = self.count[giver] // 2 if giver == taker else min(self.count[giver], self.count[taker])
        self.change(giver, -n)
        self.change(taker, -n)
        self.change(_moved(giver, given, back), n)
        self.change(_moved(taker, back, given), n)
        self.exchanges += 1

    def best(self, contents: tuple) -> tuple | None:
        """The exchange with a bin of these contents that raises the sum of squared fills most: move, one for one, two for one."""
        value, kind, room, of = self.under.live()
        own, number = self.capacity - sum(contents), self.numbers[contents]
        alive = of >= 0 if self.count[contents] > 1 else (of >= 0) & (of != number)
        top, found = 0, None
        gives, takes = alive & (kind < 2), alive & (kind > 0)
        ones, twos = sorted(set(contents)), {x + y: (x, y) for x, y in combinations(contents, 2)}
        v, r, o = value[gives], room[gives], of[gives]
        for x, given in [*((x, (x,)) for x in ones), *twos.items()] if len(v) else ():
            gain = x - v
            squares = np.where((gain > 0) & (gain <= r) & ((v > 0) | (len(given) == 1)), gain * (own - r + gain), 0)
            j = int(squares.argmax())
            if squares[j] > top:
                top, found = int(squares[j]), (contents, self.names[o[j]], given, (int(v[j]),) if v[j] else ())
        v, r, o, k = value[takes], room[takes], of[takes], kind[takes]
        for y in [0, *ones] if len(v) else ():
            gain = v - y
            squares = np.where((gain > 0) & (gain <= own) & ((k == 1) | (y > 0)), gain * (r - own + gain), 0)
            j = int(squares.argmax())
            if squares[j] > top:
                giver = self.names[o[j]]
                given = (int(v[j]),) if k[j] == 1 else next(p for p in combinations(giver, 2) if sum(p) == v[j])
                top, found = int(squares[j]), (giver, contents, given, (y,) if y else ())
        return found

    def climb(self) -> None:
        """Apply gaining exchanges until no bin that changed has one."""
        while self.changed and self.bins > self.least and self.exchanges < MOST_EXCHANGES:
            contents = self.changed.pop()
            while contents in self.count and (found := self.best(contents)):
                self.exchange(*found)
                if self.bins <= self.least or self.exchanges >= MOST_EXCHANGES:
                    break

    def sideways(self) -> bool:
        """One exchange into an underfull bin that need not gain, then climb; undone if the squares have not grown in all."""
        names = [self.names[k] for k in np.unique(self.under.live()[3]) if k >= 0]
        taker = names[self.random.randrange(len(names))]
        room, choices = self.capacity - sum(taker), []
        for entries in (self.under, self.full):
            value, kind, _, of = entries.live()
            ok = (kind == 1) & (of >= 0) & (of != self.numbers[taker])
            for y in [0, *sorted(set(taker))]:
                choices += [(y, int(value[i]), int(of[i])) for i in np.flatnonzero(ok & (value > y) & (value - y <= room)).tolist()]
        if not choices:
            return False
        y, x, giver = choices[self.random.randrange(len(choices))]
        self.log, self.changed = [], []
        self.exchange(self.names[giver], taker, (x,), (y,) if y else ())
        self.climb()
        log, self.log = self.log, None
        if sum(n * sum(c) ** 2 for c, n in log) > 0:
            return True
        for contents, n in reversed(log):
            self.change(contents, -n)
        self.changed = []
        return False


def local_search(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins after exchanges (move one, one for one, two for one) that raise the sum of squared fills until bins empty.

    Where no exchange gains, sideways ones are tried: a gaining chain may follow. It ends when the number of
    bins is the least possible, after PATIENCE fruitless sideways exchanges in a row, or after MOST_EXCHANGES.
    """
    search = LocalSearch(bins, capacity)
    search.climb()
    fruitless = 0
    while search.bins > search.least and fruitless < PATIENCE and search.exchanges < MOST_EXCHANGES:
        fruitless = 0 if search.sideways() else fruitless + 1
    return list(search.count.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The local search from best fit and, unless that gives the least possible number, from a bin for each piece; the fewer bins."""
    found = local_search(best_fit(histogram, capacity), capacity)
    if sum(n for _, n in found) > -(-sum(x * n for x, n in histogram.items()) // capacity):
        found = min(found, local_search([((x,), n) for x, n in histogram.items()], capacity), key=lambda bins: sum(n for _, n in bins))
    return found


class Places:
    """Planned places by length: the r-th piece of a length has sequence and offset of its run."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        found: dict[int, list] = defaultdict(list)
        sequence = 0
        for contents, n in sorted(bins):
            offset = 0
            for length in contents:
                found[length].append((n, sequence, offset))
                offset += length
            sequence += n
        self.runs = {}
        for length, rows in found.items():
            n, first, offset = np.array(rows, np.int64).T
            self.runs[length] = (np.cumsum(n), n, first, offset)

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, n, first, offset = self.runs[length]
        run = np.searchsorted(ends, rank, side="right")
        return first[run] + rank - (ends[run] - n[run]), offset[run]


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text, ...).

    A null or empty text is one piece of end_id alone. Repeated rows and null ids are packed like others; other
    columns, of whatever name, are not read. A piece as long as a sequence has one of its own, with a negative
    number; the planned ones count from 0. An empty table gives no rows. What goes to the driver is a histogram
    of lengths, whatever the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    made = cut(pieces(docs, path, ranks_path, capacity, end_id).withColumn("_row", F.xxhash64(F.monotonically_increasing_id())))
    own, short = made.columns[:5], made.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    parts = -(-max(histogram.values(), default=1) // PART_ROWS)
    short = short.withColumn("_part", F.pmod("_row", F.lit(parts)))
    before: dict[tuple[int, int], int] = {}
    for length, rows in groupby(sorted(short.groupBy("length", "_part").count().collect()), key=lambda r: r["length"]):
        at = 0
        for r in rows:
            before[length, r["_part"]] = at
            at += r["count"]
    planned = spark.sparkContext.broadcast((Places(plan(histogram, capacity)), before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base = planned.value
        for b in batches:
            length, part, rank = (b.column(i).to_numpy() for i in (3, 5, 6))
            rank = rank + np.fromiter((base[k] for k in zip(length.tolist(), part.tolist())), np.int64, len(length))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                sequence[at], offset[at] = places.of(size, rank[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = short.select(*own, "_part", (F.row_number().over(order) - 1).cast("long").alias("_rank"))
    alone = made.where(F.col("length") == capacity).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, f"doc_id {type_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(alone)
