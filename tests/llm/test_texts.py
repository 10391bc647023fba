"""Token counts, decontamination and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from cases import SCHEMA, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame
from tokenizers import Tokenizer

from tidevec.llm import common, quality_rules, token_counts
from tidevec.llm import decontaminate as decontaminate_module
from tidevec.llm.decontaminate import Windows, decontaminate, report

DATA = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def tokens(t):
    return len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)


def test_token_counts(spark):
    for rows, df in (([(r["doc_id"], r["text"]) for r in table("documents")], spark.read.parquet(f"{DATA}/documents.parquet")), ([r[:2] for r in odd_documents()], spark.createDataFrame(odd_documents(), SCHEMA))):
        out = token_counts.count_tokens(df, P.path("word_bpe_49k.json"), 300).collect()
        want = [(i, *tokens(t)) for i, t in rows]
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == sorted(want, key=str)
        assert all(r.over_limit == (r.n_tokens > 300) for r in out)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).collect() == []


LENGTHS = token_counts.Lengths(P.path("word_bpe_49k.json"), {})


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0ab'sStTéÉ́̀1²<|endoftext|>startΣİ語"), st.characters()), max_size=60))
def test_runs_add_up(text):
    text = text.encode("utf-8", "ignore").decode()
    assert sum(LENGTHS[w] for w in text.encode().split()) == tokens(text)[1]


def normal(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(docs, items, k=8):
    out = {}
    for i, t in docs:
        w = normal(t)
        hit, names = [False] * len(w), set()
        for item, x in items:
            v = normal(x)
            n = min(k, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = [True] * n
                    names.add(str(item))
        out[i] = (len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2)
    return out


def hits(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_decontamination_of_a_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents")]
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    want = brute_hits(docs, items)
    assert sum(x[2] for x in want.values())
    df, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert hits(report(df, bench)) == want
    assert hits(report(df, bench, block_bytes=2_000)) == want


def test_blocks_keep_no_text(spark, monkeypatch):
    """Of the documents, several blocks of a benchmark keep ids, masks and items alone; a join beyond broadcast gives the same."""
    kept = []
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, keep=common.Scratch.keep: kept.append(df.columns) or keep(self, df))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    df, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    docs, items = ([(r[k], r["text"]) for r in t.collect()] for t, k in ((df, "doc_id"), (bench, "item_id")))
    assert hits(report(df, bench, block_bytes=4_000)) == brute_hits(docs, items)
    assert len(kept) > 1 and all(c == ["_doc", "_twin", "_mask", "_items"] for c in kept)


def test_windows_take_bounded_memory():
    items = [(str(i), " ".join(f"word{(i * 7919 + j * 104729) % 50_021}" for j in range(160)).encode()) for i in range(2_000)]
    windows = Windows(items, 8)
    assert windows.nbytes() <= 6 * sum(len(t) for _, t in items)
    mask, names = windows.hits(items[5][1].split())
    assert mask.all() and "5" in names


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate_module, "window_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    windows = Windows([("a", b"one two three"), ("b", b"four five six"), ("c", b"one two three")], 3)
    mask, names = windows.hits(b"zero one two three nine".split())
    assert mask.tolist() == [False, True, True, True, False] and names == {"a", "c"}


def test_clashing_names_and_types(spark):
    bench = spark.createDataFrame([("i1", "alpha beta gamma delta"), ("i2", "one two three four five")], "item_id string, text string")
    rows = [(1, "x alpha beta gamma delta y", "T", 9, b"m", ["i"], "d", 5), (1, "alpha beta gamma delta one two three four five", "T", 9, b"m", ["i"], "d", 5), (None, "clean", "T", 9, b"m", ["i"], "d", 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, TEXT string, Doc_ID int, _mask binary, _items array<string>, _doc string, _hits int")
    for block_bytes in (8_000_000, 120):
        out = decontaminate(df, bench, block_bytes=block_bytes)
        assert out.columns == df.columns
        assert sorted((r[0] or 0, " ".join(r[1].split()), r[2], r[4], r[7]) for r in out.collect()) == [(0, "clean", "T", b"m", 5), (1, "x y", "T", b"m", 5)]
        assert sorted((r.doc_id or 0, r.n_items) for r in report(df, bench, block_bytes=block_bytes).collect()) == [(0, 0), (1, 1), (1, 2)]


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    items = [(10, " ".join(passage)), (9, " ".join(passage[:12])), (2, "Tiny Item"), (3, None), (4, ""), (None, "one"), (5, "--"), (10, " ".join(passage)), (11, "ünï 語")]
    docs = [(i, t) for i, t, *_ in odd_documents()] + [(100, "x " + ", ".join(passage).upper() + "! y"), (101, "tiny\n item only"), (102, "tiny item"), (103, " ".join(rng.choice(passage) for _ in range(50))), (104, "a ünï-語 b")]
    df = spark.createDataFrame([(*d, None, None, None, *["x"] * 8) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = brute_hits(docs, [x for x in items if x[0] is not None])
    assert hits(report(df, bench)) == want
    out = decontaminate(df, bench)
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert 100 not in left and 102 not in left and left[101] == " only" and left[104] == "a  b"
    assert all(left[i] == t for i, t in docs if want[i][1] == 0)
    assert hits(report(df, bench.limit(0)))[100][1:3] == (0, 0)
    assert report(df.limit(0), bench).collect() == []


def brute_rules(t):
    space = " \t\n\x0b\x0c\r"
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if x.strip(space)]
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    r = sum(hit)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)


def test_quality_rules(spark):
    for rows, df in (([(r["doc_id"], r["text"]) for r in table("documents")], spark.read.parquet(f"{DATA}/documents.parquet")), ([r[:2] for r in odd_documents()], spark.createDataFrame(odd_documents(), SCHEMA))):
        out = quality_rules.apply_rules(df).collect()
        got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
        assert sorted(got, key=str) == sorted(((i, *brute_rules(t)) for i, t in rows), key=str)
        assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.apply_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_host_verdicts(spark, monkeypatch):
    good, junk, soft = "clean words of some length " * 1, "a b", " ".join(f"word{i}#" for i in range(40))
    text = " ".join(f"{good}{i}" for i in range(8))
    rows = [(i, text, None, "fine") for i in range(50)] + [(100 + i, junk, None, "bad") for i in range(50)] + [(200, text, None, "bad"), (201, soft, None, "bad"), (202, soft, None, "fine"), (203, text, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {**{i: True for i in range(50)}, **{100 + i: False for i in range(50)}, 200: True, 201: False, 202: True, 203: True}
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()} == want
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()} == want


def test_counts_and_rules_take_columns_by_exact_name(spark):
    rows = [(1, "one two", "src", "T", 5, "x"), (1, None, None, "T", 5, "x"), (None, "", "https://a.b/c", "T", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, TEXT string, Doc_ID int, _t string")
    counted = token_counts.count_tokens(df, P.path("word_bpe_49k.json"))
    assert dict(counted.dtypes)["doc_id"] == "int"
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted.collect()) == sorted((i or 0, *tokens(t)) for i, t, *_ in rows)
    ruled = quality_rules.apply_rules(df)
    assert dict(ruled.dtypes)["doc_id"] == "int" and sorted(r.n_words for r in ruled.collect()) == [0, 0, 2]
    assert quality_rules.apply_rules(df.where("false")).collect() == [] and token_counts.count_tokens(df.where("false"), P.path("word_bpe_49k.json")).collect() == []


def test_frequent_table_is_drawn_without_a_shuffle(spark, monkeypatch):
    """The plan of the sample has no exchange, and the lengths are the library's."""
    plans = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", lambda self, f=DataFrame.toLocalIterator: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    table_ = token_counts.frequent(docs, P.path("word_bpe_49k.json"), 500)
    assert plans and "Exchange" not in plans[0] and 0 < len(table_) <= 500
    assert all(n == len(LIBRARY.encode(w.decode(), add_special_tokens=False).ids) for w, n in list(table_.items())[:100])
