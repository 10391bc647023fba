import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, odd_documents

from tidevec.llm import language_id, toxicity

DATA = "/root/testdata/sf0.01"


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    out = language_id.identify(documents, language_id.fit(documents)).collect()
    assert len(out) == len(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.97 * len(test)
    sure = [r for r in test if r.accepted]
    assert len(sure) > 0.9 * len(test) and sum(r.lang_pred == lang[r.doc_id] for r in sure) >= 0.98 * len(sure)


def test_language_odd(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    m = language_id.fit(df)
    out = language_id.identify(df, m).collect()
    texts = {r[0]: r[1] for r in odd_documents()}
    assert len(out) == len(odd_documents())
    for r in out:
        t = texts[r.doc_id]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.fit(empty) is None and language_id.identify(empty, None).collect() == []


def test_slices_are_seamless(monkeypatch):
    text = ("Où est l'été? " * 40).encode()
    whole = sorted(x for a in language_id.subwords(text) for x in a.tolist())
    assert len(whole) > 2000
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    assert sorted(x for a in language_id.subwords(text) for x in a.tolist()) == whole


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_toxicity_accuracy(spark, model):
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    out = toxicity.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), model).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    test = [(label[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in label]
    toxic, clean = [p for y, p in test if y == 1], [p for y, p in test if y == 0]
    assert sum(toxic) >= 0.7 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_sentences_are_located(spark, model):
    df = spark.createDataFrame([(1, "The the erntre of it. You are a stupid idiot and a worthless clown! And then on."), (2, None), (3, "The and of to. It is.")], "doc_id long, text string")
    assert {(r.doc_id, r.sentence, r.text) for r in toxicity.offending_sentences(df, model).collect()} == {(1, 1, "You are a stupid idiot and a worthless clown")}
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[1].worst_sentence == 1 and out[1].predicted == 1
    assert (out[2].score, out[2].worst_sentence, out[3].predicted) == (0.0, None, 0)


def test_toxicity_odd(spark, model):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    assert len(toxicity.score(df, model).collect()) == len(odd_documents())
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


def test_long_clean_texts_stay_clean(spark, model):
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist()
    clean = [d["text"] for d in docs if d["text"] and d["lang"] == "en" and held(d["doc_id"]) and label.get(d["doc_id"]) == 0]
    sizes = [sum(1 for _ in toxicity.sentences(t)) for t in clean]
    rows = []
    for i, least in enumerate([500, 500, 2_000, 5_000, 20_000]):
        parts, n, k = [], 0, 37 * i
        while n < least:
            parts.append(clean[k % len(clean)])
            n += sizes[k % len(clean)]
            k += 1
        rows.append((i, "\n".join(parts)))
    rows.append((5, rows[2][1] + "\nYou are a stupid idiot and a worthless clown!\n" + rows[2][1]))
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[4].n_sentences >= 20_000
    assert [out[i].predicted for i in range(6)] == [0, 0, 0, 0, 0, 1]


def test_long_labelled_documents_are_learned(spark):
    plain = " ".join(f"This is harmless sentence number {'abcdefghij'[i % 10]}." for i in range(2_000))
    bad = plain + " You grumbling vermicious blatherskite!"
    assert len(plain) > 65_536
    docs = spark.createDataFrame([(i, bad if i % 2 else plain) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    weights = toxicity.WordWeights(toxicity.fit(docs, labels))
    assert weights["blatherskite"] > 1 > weights["harmless"]


def test_recall_of_held_out_toxic_documents(spark, model):
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    out = toxicity.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), model).collect()
    toxic = [r.predicted for r in out if r.held_out and label.get(r.doc_id) == 1]
    assert sum(toxic) >= 0.78 * len(toxic)


def test_recall_with_few_labels(spark):
    """sf0.01: 45 toxic documents to learn from; 2 of the 6 held out are found, and none of 64 clean ones is flagged."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(label[r.doc_id], r.predicted) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.held_out and r.doc_id in label]
    assert sum(p for y, p in test if y == 1) >= 2 and sum(p for y, p in test if y == 0) == 0


def plain_score(text, model):
    """The noisy-or of a text by plain loops over sentences, words and their beginnings."""
    left, n = 1.0, 0
    found = []
    for s in re.split(r"[.!?\n]+", (text or "").lower()):
        words = set(re.findall(r"[^\W\d_]+", s))
        if words:
            z = model.bias
            for w in words:
                codes = [zlib.crc32(w.encode())] + [zlib.crc32(w[:k].encode() + b"-") for k in (4, 5, 6, 7, 8) if k < len(w)]
                z += sum(model.weights.get(c, 0.0) for c in codes)
            found.append(z)
            n += 1
    for z in found:
        left *= 1 - 1 / (1 + math.exp(-(z - math.log(max(n / toxicity.LONG, 1)))))
    return 1 - left if n else 0.0


def test_scores_against_plain_loops(spark, documents, model):
    texts = {r.doc_id: r.text for r in documents.collect()} | {-1: "Odd. Ünïcode stupid! 語", -2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], model)) < 1e-9


def plain_language(text, m):
    """Mean of the embeddings of all 1- to 4-grams, softmax, by plain loops."""
    b = [32, *(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()), 32]
    total, n = np.zeros(m.embeddings.shape[1]), 0
    for i in range(len(b)):
        h = 0
        for k in range(4):
            if i + k >= len(b):
                break
            h = (h + b[i + k] + k + 1) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            total += m.embeddings[(h * 0x85EBCA77 % 2**32) >> 17]
            n += 1
    z = ((total / n if m.out is None else total / n @ m.out) + m.bias) / m.temperature
    p = [math.exp(x - max(z)) for x in z]
    return m.languages[p.index(max(p))], max(p) / sum(p)


def test_languages_against_plain_loops(spark, documents):
    m = language_id.fit(documents)
    rows = [r for r in documents.collect() if r.text and any(c.isalpha() for c in r.text)][:60]
    out = {r.doc_id: r for r in language_id.identify(documents, m).collect()}
    for r in rows:
        lang, p = plain_language(r.text, m)
        assert out[r.doc_id].lang_pred == lang and abs(out[r.doc_id].score - p) < 1e-9


def many_languages(n):
    rng = random.Random(4)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(n)]
    return [(i, " ".join(rng.choice(vocabulary[i % n]) for _ in range(40)), f"l{i % n}") for i in range(24 * n)]


def test_every_language_is_learned(spark):
    """250 languages, one of them in texts of over LONG bytes only; more than DIMENSIONS of them keep the softmax apart."""
    rows = many_languages(250)
    rows += [(10_000 + i, ("zygo mbwexi ktrull " * 5_000), "long") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(df)
    assert len(m.languages) == 251 and m.out is not None
    text = "zygo mbwexi ktrull zygo"
    assert m.predict(text.encode())[0] == "long"
    lang, p = plain_language(text, m)
    assert lang == "long" and abs(m.predict(text.encode())[1] - p) < 1e-9
    out = language_id.identify(df.where("doc_id < 6000"), m).where("held_out").collect()
    lang_of = {i: x for i, _, x in rows}
    assert sum(r.lang_pred == lang_of[r.doc_id] for r in out) >= 0.9 * len(out)


def test_clashing_names_and_types(spark, model):
    rows = [(i, t, x, "T", 1, 0.5) for i, t, x, *_ in odd_documents() if i is not None]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, TEXT string, Doc_ID int, share double")
    found = language_id.identify(df, language_id.fit(df))
    assert dict(found.dtypes)["doc_id"] == "int" and found.count() == len(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id int, toxic int")
    scored = toxicity.score(df, toxicity.fit(df, labels))
    assert dict(scored.dtypes)["doc_id"] == "int" and scored.count() == len(rows)
    assert all(r.doc_id is not None for r in toxicity.offending_sentences(df, model).collect())


def test_sentences_of_odd_rows(spark, model):
    bad = "You are a stupid idiot and a worthless clown"
    rows = [(1, None), (2, ""), (3, "1 2 3. !!"), (4, f"{bad}!"), (4, f"{bad}!"), (None, f"Fine. {bad}."), (5, "fine " * 30_000 + ". " + bad)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sentence string")
    found = sorted(((r.doc_id or 0, r.sentence, r.text) for r in toxicity.offending_sentences(df, model).collect()))
    assert found == [(0, 1, bad), (4, 0, bad), (4, 0, bad), (5, 1, bad)]
    assert toxicity.offending_sentences(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
