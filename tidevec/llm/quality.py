"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic classifier on counts of the whole text gives each document a probability of being good. These
are summed by host and by first path segment. A host's rate is a beta posterior whose prior (mean and
strength) is fitted to all hosts by moments; a path's rate is one whose prior is its host's rate, with a
strength fitted to the spread of paths within hosts. So sites with few documents shrink toward the global
rate, and paths toward their host's. A document's score adds its site's log odds, without the document's own
share and relative to the global rate, to its own log odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidevec.llm.common import BROADCAST_BYTES, as_bytes, cut, is_training, maybe_broadcast, numbered, only, place_of, prepare, type_of

#: Bound of the training sample: labelled documents, by hash of the id. Only their counts are collected.
TRAINING_DOCS = 20_000
STEPS, RATE, DECAY = 3_000, 0.3, 1e-3
#: Limits of a fitted prior's strength, in documents.
STRENGTH = (5.0, 10_000.0)
#: Weight of the site's log odds against the document's own, and the score under which a document is rejected.
SITE_WEIGHT, LEAST_SCORE = 1.0, 0.5
SALTS = 64

_CLASSES = np.zeros((256, 6))
for _i, _members in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"\n", b".,;:")):
    _CLASSES[list(_members), _i] = 1
N_FEATURES = 13


def features(text: bytes | None) -> np.ndarray:
    """Counts of the whole text: lengths, shares of character classes, repetition of words and lines."""
    if not text:
        return np.zeros(N_FEATURES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / len(text)
    same = sum(map(eq, words, words[1:])) / n
    different = len(set(words)) / n
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    return np.array([*np.sqrt(shares), np.log1p(len(words)), np.log1p(len(text) / n), same, different, different * np.log1p(n) / 5, repeated, len(lines) / n])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good, within -12 and 12; squares of the standardised counts are features too."""
        return np.clip(_expand((x - self.mean) / self.scale) @ self.weights + self.bias, -12, 12)


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by gradient descent with momentum; without both labels, log odds are 0."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w, b = np.zeros(2 * N_FEATURES), 0.0
    if len(set(y.tolist())) == 2:
        z = _expand((x - mean) / scale)
        z_scale = np.maximum(z.std(0), 1.0)
        z = z / z_scale
        vw, vb = np.zeros_like(w), 0.0
        for _ in range(STEPS):
            d = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
            vw, vb = 0.9 * vw - RATE * 0.1 * (z.T @ d / len(y) + DECAY * w), 0.9 * vb - RATE * 0.1 * d.mean()
            w, b = w + vw, b + vb
        w = w / z_scale
    return Model(mean, scale, w, float(b))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled documents of the training folds; of rows of equal id the one with the least counts is learned from."""
    prepare(docs.sparkSession)
    labels = only(labels, "doc_id", "quality")
    known = labels.where(is_training(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = int(min(1.0, TRAINING_DOCS / max(1, known.count())) * 1_000_000) + 1
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in as_bytes(b.column(2))], pa.list_(pa.float64()))], ["id", "quality", "x"])

    sample = only(docs, "doc_id", "text").join(maybe_broadcast(chosen, 2 * TRAINING_DOCS, 16), "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int"), "text")
    rows = sample.mapInArrow(run, "id string, quality int, x array<double>").groupBy("id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).collect()
    x, y = np.array([r.x for r in rows]).reshape(-1, N_FEATURES), np.array([float(r.quality == 1) for r in rows])
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def site(source: Column) -> tuple[Column, Column]:
    """Host (up to the first slash, after a scheme) and host with first path segment; empty for null."""
    s = F.coalesce(source.cast("string"), F.lit(""))
    host = F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)
    return host.alias("_host"), F.concat(host, F.lit("/"), F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*/([^/?#]*)", 1)).alias("_path")


def document_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, _host, _path, _logit of each row: also of null texts (counted as empty) and null sources (one site)."""
    spark = docs.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for b in batches:
            x = np.array([features(t) for t in as_bytes(b.column(3))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(m.logit(x))], ["doc_id", "_host", "_path", "_logit"])

    return only(docs, "doc_id", "source", "text").select("doc_id", *site(F.col("source")), "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, _host string, _path string, _logit double")


def _p(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _strength(mean: float, between: float) -> float:
    """Of a beta with this mean whose variance is between; the upper limit if nothing is left of the spread."""
    return min(max(mean / between - 1, STRENGTH[0]), STRENGTH[1]) if between > 0 else STRENGTH[1]


def sites(scores: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """By path: _host_sum, _host_n, _path_sum, _path_n; and the priors: mean and strength of hosts, strength of paths.

    Strengths come from the spread of rates (of hosts, and of paths about their host) less what chance gives
    sites of their sizes. Hosts of one path say nothing about paths; if there are no others, a path's rate is
    its host's.
    """
    paths = scores.groupBy("_host", "_path").agg(F.sum(_p(F.col("_logit"))).alias("_path_sum"), F.count(F.lit(1)).cast("double").alias("_path_n"))
    hosts = paths.groupBy("_host").agg(F.sum("_path_sum").alias("_host_sum"), F.sum("_path_n").alias("_host_n"), F.count(F.lit(1)).alias("_paths"))
    rate = F.col("_host_sum") / F.col("_host_n")
    r = hosts.agg((F.sum("_host_sum") / F.sum("_host_n")).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("_host_n")).alias("noise")).first()
    mean = min(max(r["mean"] if r["mean"] is not None else 0.5, 1e-3), 1 - 1e-3)
    binomial = mean * (1 - mean)
    strength = _strength(binomial, (r["spread"] or 0.0) - binomial * (r["noise"] or 0.0))
    table = paths.join(hosts, "_host")
    by_chance = rate * (1 - rate)
    spread = F.sum((F.col("_path_sum") / F.col("_path_n") - rate) ** 2).alias("spread")
    noise = F.sum(by_chance * (1 / F.col("_path_n") - 1 / F.col("_host_n"))).alias("noise")
    within = table.where("_paths > 1").agg(spread, noise, F.sum(by_chance).alias("all")).first()
    path_strength = _strength(within["all"] or 0.0, (within["spread"] or 0.0) - (within["noise"] or 0.0))
    return table.drop("_paths"), (mean, strength, path_strength)


def with_sites(rows: DataFrame, table: DataFrame, salted_by: Column) -> DataFrame:
    """rows with their site's sums: by broadcast up to BROADCAST_BYTES, beyond by a salted join."""
    table = table.drop("_host")
    if table.count() * 150 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "_path", "left")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salted_by), F.lit(SALTS)).cast("int")).join(spread, ["_path", "_salt"], "left").drop("_salt")


def posterior(logit: Column, prior: tuple[float, float, float], site_weight: float) -> tuple[Column, Column, Column]:
    """Host rate, path rate (both without the document itself) and score."""
    mean, strength, path_strength = prior
    own = _p(logit)
    host = (F.col("_host_sum") - own + strength * mean) / (F.col("_host_n") - 1 + strength)
    path = (F.col("_path_sum") - own + path_strength * host) / (F.col("_path_n") - 1 + path_strength)
    path = F.greatest(F.least(path, F.lit(1 - 1e-3)), F.lit(1e-3))
    odds = logit + site_weight * (F.log(path / (1 - path)) - float(np.log(mean / (1 - mean))))
    return host, path, _p(odds)


def classify(docs: DataFrame, labels: DataFrame, site_weight: float = SITE_WEIGHT, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score, kept for each row of docs(doc_id, text, source, ...).

    kept: score >= least. Null texts count as empty and null sources as one site. Repeated rows and null
    ids give a row each; an empty table gives no rows; without labels of both kinds only sites count. Other
    columns, of whatever name, are not read.
    """
    scores = cut(document_scores(docs, fit(docs, labels)))
    table, prior = sites(scores)
    host, path, score = posterior(F.col("_logit"), prior, site_weight)
    rows = with_sites(scores, table, F.col("doc_id")).select("doc_id", _p(F.col("_logit")).alias("doc_score"), host.alias("host_rate"), path.alias("path_rate"), score.alias("score"))
    return rows.withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, site_weight: float = SITE_WEIGHT, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs that classify() keeps, unchanged, extra columns of whatever name included.

    Nulls, repeated rows and empty tables are as in classify(). Texts are scored where they lie; none is shuffled.
    """
    spark = docs.sparkSession
    model = fit(docs, labels)
    table, prior = sites(cut(document_scores(docs, model)))
    own = spark.sparkContext.broadcast(model)
    names, plain = docs.columns, numbered(docs)
    text_at, id_at, source_at = (place_of(docs, c) for c in ("text", "doc_id", "source"))
    marked = plain.withColumns({c: x for c, x in zip(("_host", "_path"), site(F.col(f"c{source_at}")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in as_bytes(b.column(text_at))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.value.logit(x))], names=[*b.schema.names, "_logit"])

    joined = with_sites(marked, cut(table, table.count()), F.col(f"c{id_at}")).select(*plain.columns, "_host_sum", "_host_n", "_path_sum", "_path_n")
    scored = joined.mapInArrow(run, joined.withColumn("_logit", F.lit(0.0)).schema)
    return scored.where(posterior(F.col("_logit"), prior, site_weight)[2] >= least).select(*plain.columns).toDF(*names)
