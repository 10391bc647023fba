"""Language identification: averaged hashed subword embeddings, a linear softmax, numpy SGD, calibrated rejection.

Subwords are byte n-grams of the lower-cased text, white space and ASCII punctuation made one kind of gap.
A text's vector is the mean of its subwords' embeddings; embeddings and softmax are trained together on a
bounded sample. A held-back part of the sample sets the temperature of the softmax and the score under
which a prediction is rejected. As the model is linear in the subwords, prediction uses one table of
summed class scores by subword.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import as_bytes, is_training, only, prepare, record_batch, type_of

#: Bounds of the training sample: documents in all and of each language (one at least), by hash of the id, and
#: bytes of all of them. Languages take turns; of each, documents over LONG bytes come last.
TRAINING_DOCS, DOCS_PER_LANGUAGE, TRAINING_BYTES, LONG = 8_000, 1_000, 48 << 20, 65_536
BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
EPOCHS, RATE = 4, 0.5
#: Bytes that are hashed at once, which bounds memory for long texts.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

#: Every ASCII byte that is no letter counts as a gap.
_PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)
LETTER = re.compile(r"[^\W\d_]")


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, with a gap at both ends; a slice reads back as far as its grams do."""
    raw, gap, back = np.frombuffer(text, np.uint8), np.full(1, 32, np.uint32), GRAMS[-1] - 1
    for i in range(0, len(raw), SLICE_BYTES):
        own = max(0, i - back)
        b = np.concatenate(([] if i else gap, _PLAIN[raw[own : i + SLICE_BYTES]], gap if i + SLICE_BYTES >= len(raw) else [])).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, GRAMS[-1] + 1):
            if len(b) < n:
                break
            h = (h[: len(b) - n + 1] + b[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in GRAMS:
                # What ended before the slice was counted in the one before.
                yield ((h[max(0, i - own - n + 1) if i else 0 :] * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    """Of few languages, embeddings hold class scores by bucket and out is None; both are the same function."""

    languages: list[str]
    embeddings: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    least_score: float

    def predict(self, text: bytes) -> tuple[str, float]:
        """Most likely language and its calibrated probability."""
        total, n = np.zeros(self.embeddings.shape[1]), 0
        for at in subwords(text):
            total += np.bincount(at, minlength=BUCKETS) @ self.embeddings
            n += len(at)
        z = total / max(n, 1)
        p = softmax(((z if self.out is None else z @ self.out) + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[bytes], languages: list[str], seed: int = 7) -> Model:
    """Fit embeddings and softmax by SGD; every fifth text is held back to calibrate."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    features = []
    for t in texts:
        at, n = np.unique(np.concatenate([*subwords(t), np.zeros(0, np.int64)]), return_counts=True)
        features.append((at, (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    order = rng.permutation(len(texts))
    fit, held = (order[np.arange(len(order)) % 5 > 0], order[::5]) if len(texts) >= 20 else (order, order)
    steps, total = 0, EPOCHS * max(1, len(fit))
    weight = len(fit) / (len(names) * np.maximum(1, np.bincount(y[fit], minlength=len(names))))
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            at, share = features[i]
            hidden = share @ emb[at]
            g = softmax(hidden @ out + bias)
            g[y[i]] -= 1
            rate = np.float32(RATE * (1 - steps / total) * min(weight[y[i]], 5.0))
            steps += 1
            back = out @ g
            out -= rate * np.outer(hidden, g)
            bias -= rate * np.float32(0.1) * g
            # The mean spreads a gradient over many subwords; their rate makes up for it.
            emb[at] -= rate * np.float32(10) * share[:, None] * back
    z = np.array([features[i][1] @ emb[features[i][0]] @ out + bias for i in held])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-9).mean()
    temperature = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
    p = softmax(z / temperature)
    table = ((emb @ out).astype(np.float64), None) if len(names) <= DIMENSIONS else (emb.astype(np.float64), out.astype(np.float64))
    return Model(names, *table, bias.astype(np.float64), temperature, _least(p.max(1), p.argmax(1) == y[held]))


def _least(score: np.ndarray, right: np.ndarray, precision: float = 0.99) -> float:
    """The least score from which on predictions of the held-back texts are right at least so often."""
    order = np.argsort(-score)
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    return float(score[order[good[-1]]]) if len(good) else 0.5


def fit(docs: DataFrame) -> Model | None:
    """Train on docs(doc_id, text, lang) of the training folds; None if no row there has text and language.

    Every language is learned, by its short documents first; a document that alone is over TRAINING_BYTES is passed over.
    """
    docs = only(docs, "doc_id", "lang", "text").withColumn("lang", F.col("lang").cast("string"))
    rows = docs.where(is_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, min(DOCS_PER_LANGUAGE, TRAINING_DOCS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(x, int(min(1.0, 2 * each / n) * 1_000_000) + 1) for x, n in counts.items()], "lang string, share long")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = rows.join(F.broadcast(shares), "lang").where(turn < F.col("share"))
    sizes = sample.groupBy("lang", "doc_id").agg(F.sum(F.octet_length("text") + 100).alias("size"), F.min(turn).alias("turn")).collect()
    by_language: dict[str, list] = defaultdict(list)
    for r in sorted(sizes, key=lambda r: (r["size"] > LONG, r["turn"], r["doc_id"])):
        by_language[r["lang"]].append(r)
    taken, total = [], 0
    for rank in range(each):
        for lang in sorted(by_language):
            if rank < len(by_language[lang]) and total + by_language[lang][rank]["size"] <= TRAINING_BYTES:
                taken.append((lang, by_language[lang][rank]["doc_id"]))
                total += by_language[lang][rank]["size"]
    chosen = docs.sparkSession.createDataFrame(taken, f"lang string, doc_id {type_of(docs, 'doc_id')}")
    found = sorted((r.doc_id, r.lang, r.text.encode("utf-8", "replace")) for r in rows.join(F.broadcast(chosen), ["lang", "doc_id"]).collect())
    return train([t for _, _, t in found], [x for _, x, _ in found]) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row of docs(doc_id, text, ...).

    A text that is null or has no letter is `und` with score 0; so is every text if there is no model.
    accepted: score at or above the calibrated least score. Only text is read for a prediction, all of it.
    Repeated rows and null ids (held out) give a row each; other columns, of whatever name, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for b in batches:
            lang, score = [], []
            for text in as_bytes(b.column(1)):
                if m is None or not text or not LETTER.search(text.decode("utf-8", "replace")):
                    k, p = UNKNOWN, 0.0
                else:
                    k, p = m.predict(text)
                lang.append(k)
                score.append(p)
            ok = [x != UNKNOWN and p >= m.least_score for x, p in zip(lang, score)]
            yield record_batch(doc_id=b.column(0), held_out=b.column(2), lang_pred=(lang, pa.string()), score=(score, pa.float64()), accepted=(ok, pa.bool_()))

    kind, docs = type_of(docs, "doc_id"), only(docs, "doc_id", "text")
    return docs.select("doc_id", "text", (~is_training(F.col("doc_id"))).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
