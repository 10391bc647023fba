"""Toxicity by multiple-instance learning: sentences are instances, only documents have labels.

A sentence's score is a logistic of the summed weights of its words and their beginnings; a document's score
is the noisy-or of its sentences. Both are trained together from document labels with AdaGrad in numpy on
a bounded sample; a held-back part of it sets scale and offset so that harmless sentences, however many,
stay harmless. The same sentence scores then locate offending sentences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import is_training, maybe_broadcast, only, prepare, record_batch, type_of

#: Bounds of the training sample: labelled documents, by hash of the id, and bytes of all of them together.
TRAINING_DOCS, TRAINING_BYTES = 6_000, 32 << 20
STEMS = (4, 5, 6, 7, 8)
#: Features are those in at least this share of the training documents; the model keeps the heaviest.
LEAST_SHARE, MOST_FEATURES, COUNT_BITS = 0.006, 200_000, 22
#: The bias begins low and moves slowly: most sentences offend nobody.
EPOCHS, RATE, BIAS, DECAY = 6, 0.3, -4.0, 1e-2
#: So many toxic labels are taken to be wrong, and a step of the bias counts no gradient above this: neither a
#: wrong label nor a long document rules the bias.
WRONG, STEEPEST = 0.05, 5.0
#: Scales and offsets tried on the held-back part; the offset falls with the logarithm of the sentences over
#: LONG. Of harmless sentences, as many as LOADS, the sum of -log(1 - p) stays under MOST_LOAD (0.69 is a score of 0.5).
SCALES, OFFSETS, LONG, LOADS, MOST_LOAD = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0), np.arange(-2, 3.25, 0.25), 1_000, (1_000, 20_000, 1_000_000), 0.25
WORD_ENTRIES, LONGEST_KEPT = 200_000, 48

WORD, END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")


def features(word: str) -> list[int]:
    """Codes of a word itself and of its beginnings, which inflected forms have in common."""
    w = word.encode("utf-8", "replace")
    return [zlib.crc32(w), *(zlib.crc32(word[:n].encode("utf-8", "replace") + b"-") for n in STEMS if n < len(word))]


def sentences(text: str) -> Iterator[set[str]]:
    """Distinct words of each sentence that has any; sentences end at . ! ? and line feeds."""
    for s in END.split(text.lower()):
        if words := set(WORD.findall(s)):
            yield words


def noisy_or(z: np.ndarray) -> float:
    """1 - product of (1 - logistic(z))."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def floor(n: int) -> float:
    """What the logits of each of n sentences are lowered by, so that the chance of a false one stays equal."""
    return float(np.log(max(n / LONG, 1.0)))


class WordFeatures(dict):
    """Codes of words, kept while training."""

    def __missing__(self, word: str) -> list[int]:
        found = features(word)
        if len(word) <= LONGEST_KEPT and len(self) < WORD_ENTRIES:
            self[word] = found
        return found


@dataclass
class Model:
    weights: dict[int, float]  # by code
    bias: float


class WordWeights(dict):
    """Summed weights of words, kept for a worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.bias, self.feature = model.bias, model.weights.get

    def __missing__(self, word: str) -> float:
        get = self.feature
        v = sum(get(x, 0.0) for x in features(word))
        if len(word) <= LONGEST_KEPT and len(self) < WORD_ENTRIES:
            self[word] = v
        return v


def sentence_logits(text: str, weight: WordWeights) -> np.ndarray:
    """Logits of the sentences. A word counts once in a sentence, so repeating it does not raise the score."""
    return np.array([weight.bias + sum(map(weight.__getitem__, s)) for s in sentences(text)])


def descend(bags: list, labels: list[int], size: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the noisy-or likelihood of document labels.

    No weight is negative, so common words do not outweigh a certain one. Logits of a long document are
    lowered so that at first it is no surer to be toxic than others: a sure one would teach nothing.
    """
    w, seen, bias, seen_bias = np.zeros(size), np.full(size, 1e-2), BIAS, 1.0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            u, inverse, of, n = bags[i]
            if not n:
                continue
            z = bias - max(np.log(n) + BIAS, 0.0) + np.bincount(of, w[u][inverse], n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(-np.logaddexp(0, z).sum())
            g = p if not labels[i] else -p * none * (1 - WRONG) / (1 - (1 - WRONG) * none)
            d = np.bincount(inverse, g[of], len(u)) + DECAY * w[u]
            seen[u] += d * d
            w[u] = np.maximum(w[u] - RATE * d / np.sqrt(seen[u]), 0.0)
            d = min(max(g.sum(), -STEEPEST), STEEPEST)
            seen_bias += d * d
            bias -= 0.1 * RATE * d / np.sqrt(seen_bias)
    return w, float(bias)


def calibrate(logits: list[np.ndarray], labels: list[int]) -> tuple[float, float]:
    """Scale and offset, logits becoming scale * (z + offset), with which most documents are told right.

    Only those count under which LOADS harmless sentences (of clean documents told right) stay harmless;
    of equals, the one with the least sum over them.
    """
    tried = []
    for scale in SCALES:
        for offset in OFFSETS.tolist():
            told = [noisy_or(scale * (z + offset) - floor(len(z))) >= 0.5 for z in logits]
            harmless = [z for z, t, y in zip(logits, told, labels) if not t and not y]
            z = scale * (np.concatenate(harmless or [np.full(1, -30.0)]) + offset)
            load = max(n * np.logaddexp(0, z - floor(n)).mean() for n in LOADS)
            right = sum(t == bool(y) for t, y in zip(told, labels))
            tried.append((*((1, right, -load) if load <= MOST_LOAD else (0, -load, 0)), scale, offset))
    return max(tried)[3:]


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Fit weights and bias; a fifth of the texts is held back first for scale and offset, then all are learned."""
    if not any(labels):
        return Model({}, -30.0)
    # Documents of a feature are counted by the low bits of its code: none that is common is missed.
    seen_in, codes_of = np.zeros(1 << COUNT_BITS, np.uint16), WordFeatures()
    for text in texts:
        words = {word for s in sentences(text) for word in s}
        seen_in[np.unique(np.fromiter({x for word in words for x in codes_of[word]}, np.int64) & (len(seen_in) - 1))] += 1
    common = (seen_in >= max(2, LEAST_SHARE * len(texts))).astype(np.uint8).tobytes()
    index: dict[int, int] = {}
    bags = []
    for text in texts:
        at, of, n = array("i"), array("i"), 0
        for s in sentences(text):
            for word in sorted(s):
                for x in codes_of[word]:
                    if common[x & (len(common) - 1)]:
                        at.append(index.setdefault(x, len(index)))
                        of.append(n)
            n += 1
        u, inverse = np.unique(np.array(at, np.int32), return_inverse=True)
        bags.append((u, inverse.astype(np.int32), np.array(of, np.int32), n))
    part = np.arange(len(texts)) % 5
    learned, held = np.flatnonzero(part).tolist(), np.flatnonzero(part == 0).tolist()
    w, bias = descend([bags[i] for i in learned], [labels[i] for i in learned], len(index), seed)
    logits = [bias + np.bincount(of, w[u][inverse], n) for u, inverse, of, n in (bags[i] for i in held)]
    scale, offset = calibrate(logits, [labels[i] for i in held])
    w, bias = descend(bags, labels, len(index), seed)
    w, bias = scale * w, scale * (bias + offset)
    codes = list(index)
    kept = np.argsort(-w, kind="stable")[:MOST_FEATURES]
    return Model({codes[i]: float(w[i]) for i in kept.tolist() if w[i] > 1e-3}, bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents of the training folds, long ones too; without a toxic one, every score is near 0.

    Documents are taken by hash of the id until TRAINING_BYTES are reached; one that alone does not fit is passed over.
    """
    docs, labels = only(docs, "doc_id", "text"), only(labels, "doc_id", "toxic")
    known = labels.where(is_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = int(min(1.0, TRAINING_DOCS / max(1, known.count())) * 1_000_000) + 1
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.where("text is not null").join(maybe_broadcast(chosen, 2 * TRAINING_DOCS, 16), "doc_id")
    sizes, taken, total = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text") + 100).alias("size"), F.xxhash64("doc_id").alias("turn")).collect(), [], 0
    for r in sorted(sizes, key=lambda r: (r.turn, r.doc_id)):
        if total + r.size <= TRAINING_BYTES:
            taken.append(r.doc_id)
            total += r.size
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], f"doc_id {type_of(docs, 'doc_id')}")), "doc_id", "left_semi")
    found = sorted((r.doc_id, r.text, int(r.toxic == 1)) for r in rows.collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_sentence for each row of docs(doc_id, text, ...).

    worst_sentence is the number (from 0, of those with a word) of the sentence that scores highest, null
    without sentences. Null texts and texts without words score 0. Only text is read for a score, all of
    it. Repeated rows and null ids (held out) give a row each; other columns, of whatever name, are not read.
    """
    return _scored(docs, model, False)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number), text and score of each sentence that alone scores at least `least`.

    Null texts and texts without words have none. Repeated rows and null ids give their sentences each; an empty
    table gives no rows; other columns, of whatever name, are not read.
    """
    return _scored(docs, model, True, least)


def _scored(docs: DataFrame, model: Model, located: bool, least: float = 0.5) -> DataFrame:
    spark, kind, docs = docs.sparkSession, type_of(docs, "doc_id"), only(docs, "doc_id", "text")
    prepare(spark)
    table = spark.sparkContext.broadcast(model)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = WordWeights(table.value)
        for b in batches:
            p, n, worst = [], [], []
            for text in b.column(1).to_pylist():
                z = sentence_logits(text, w) if text else np.empty(0)
                p.append(noisy_or(z - floor(len(z))) if len(z) else 0.0)
                n.append(len(z))
                worst.append(int(z.argmax()) if len(z) else None)
            told = [int(x >= 0.5) for x in p]
            made = {"score": (p, pa.float64()), "predicted": (told, pa.int32()), "n_sentences": (n, pa.int64()), "worst_sentence": (worst, pa.int64())}
            yield record_batch(doc_id=b.column(0), held_out=b.column(2), **made)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = WordWeights(table.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                written = [s.strip() for s in END.split(text or "") if WORD.search(s)]
                for k, z in enumerate(sentence_logits(text or "", w).tolist()):
                    p = noisy_or(np.array([z]))
                    if p >= least:
                        rows.append((doc, k, written[k], p))
            types = (b.schema.field(0).type, pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "sentence", "text", "score"])

    if located:
        return docs.mapInArrow(spots, f"doc_id {kind}, sentence long, text string, score double")
    rows = docs.select("doc_id", "text", (~is_training(F.col("doc_id"))).alias("held_out"))
    return rows.mapInArrow(totals, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences long, worst_sentence long")
