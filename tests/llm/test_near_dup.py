import itertools

import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, odd_documents

from tidevec.llm import common, near_dup
from tidevec.llm.common import Scratch
from tidevec.llm.graph import components
from tidevec.llm.near_dup import drop_near_duplicates, near_duplicates

DATA = "/root/testdata/sf0.001"


def brute(rows, k, percent=80):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("k", [2, 5])
def test_odd_documents(spark, k):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    out = near_duplicates(df, shingle=k)
    assert got(out) == brute([r[:2] for r in rows if r[0] is not None], k)
    assert len(out.collect()) == len(rows)
    lone = out.where("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in lone] == [(None, True)]
    kept = drop_near_duplicates(df, shingle=k)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.where("kept").collect()}


@pytest.mark.parametrize("most", [near_dup.MOST_CLASSES, 2])
def test_table(spark, most):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got(near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"), shingle=2, most=most)) == brute([(r["doc_id"], r["text"]) for r in t], 2)


def near_copies(n, edits):
    """n copies of one text, each with some words of its own: many are linked with others, but not with the first."""
    import random

    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in rng.sample(range(100), edits[i % len(edits)]):
            w[j] = f"x{rng.randrange(3)}{j}"
        rows.append((i, " ".join(w)))
    return rows


def test_what_stars_miss_is_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 8_000)  # many blocks for each bucket
    monkeypatch.setattr(near_dup, "TASK_BYTES", 50_000)
    rows = near_copies(150, (0, 4, 8, 11, 14))
    want = brute(rows, 2)
    assert 2 < len({c for _, c in want.values()}) < 150
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)) == want


def one_band_pair():
    """Two texts of similarity 24 / 30 that share one band only."""
    import random

    rng = random.Random(2837)
    w = [f"{rng.randrange(10**6):x}" for _ in range(28)]
    return " ".join(w), " ".join(w[3:] + [f"{rng.randrange(10**6):x}" for _ in range(3)])


def test_links_of_divided_buckets_that_no_further_band_holds(spark):
    a, b = one_band_pair()
    keys = [near_dup.signature(near_dup.shingle_set(t.encode(), 2)) for t in (a, b)]
    assert (keys[0] == keys[1]).sum() == 1
    rows = [(1, a), (2, b), (3, "one more text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (near_dup.MOST_CLASSES, 1):  # a bucket of two is over 1
        assert got(near_duplicates(df, shingle=2, most=most)) == brute(rows, 2)
    assert [r.doc_id for r in drop_near_duplicates(df, shingle=2, most=1).collect()] == [1, 3]


@pytest.mark.parametrize("most", [1, 10])
def test_large_buckets_in_several_passes(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "PASS_BYTES", 20_000, raising=False)
    monkeypatch.setattr(near_dup, "TASK_BYTES", 50_000)
    rows = near_copies(150, (0, 4, 8, 11, 14))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(df, shingle=2, most=most)) == brute(rows, 2)


def test_rare_shingles_and_passes_alone_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PASS_BYTES", 10_000)  # several passes
    monkeypatch.setattr(near_dup, "TASK_BYTES", 50_000)
    rows = near_copies(150, (0, 4, 8, 11, 14)) + [(200 + i, t) for i, t in enumerate(one_band_pair())]
    sets = [(b"%03d" % i, near_dup.shingle_set(t.encode(), 2)) for i, t in rows]
    large = spark.createDataFrame([(1, d, len(x)) for d, x in sets], "key long, digest binary, n long")
    whole = spark.createDataFrame([(d, x.tobytes()) for d, x in sets], "digest binary, words binary")
    none = spark.createDataFrame([], "v binary, label binary")
    scratch = Scratch(spark)
    found = components(near_dup.linked_in_large(large, none, whole, 80, scratch), scratch)
    label = {int(bytes(r.v)): int(bytes(r.label)) for r in found.collect()}
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute(rows, 2).items()}
    scratch.close()


def test_blocks_alone_find_all_links(spark):
    import numpy as np

    rows = near_copies(60, (0, 6, 12))
    sets = [near_dup.shingle_set(t.encode(), 2) for _, t in rows]
    component = np.arange(60)
    near_dup.link(list(range(60)), list(range(60)), component, sets, 80)
    want = brute(rows, 2)
    for i, j in itertools.combinations(range(60), 2):
        assert (component[i] == component[j]) == (want[i][1] == want[j][1])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b + " c"), (3, b + " c"), (4, a), (4, a + " z")], "doc_id int, text string")
    assert sorted(map(tuple, drop_near_duplicates(df).collect())) == [(1, a), (2, b)]
    out = near_duplicates(df)
    assert dict(out.dtypes)["doc_id"] == dict(out.dtypes)["component_id"] == "int"
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out.collect()) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False), (4, 1, False), (4, 1, False)]


def test_one_id_with_two_near_texts(spark):
    a = " ".join(f"a{i}" for i in range(50))
    kept = drop_near_duplicates(spark.createDataFrame([(1, a), (1, a + " z")], "doc_id long, text string")).collect()
    assert len(kept) == 1


def test_clashing_names(spark):
    a = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(1, a, "x", 1, "p", b"q", 2), (2, a, "y", 2, "p", b"q", 2)], "doc_id long, text string, TEXT string, Doc_ID int, _id string, digest binary, _twin int")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, a, "x", 1, "p", b"q", 2)]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {(r.v, r.label) for r in components(e, Scratch(spark)).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_joins_beyond_broadcast(spark, monkeypatch):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, drop_near_duplicates(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(str, drop_near_duplicates(df).collect())) == want
    assert got(near_duplicates(df)) == brute([r[:2] for r in rows if r[0] is not None], 5)


def test_sieve_lets_all_keys_through(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs, few = spark.range(3_000).selectExpr("id AS k", "id % 7 AS v"), spark.range(0, 3_000, 11).selectExpr("id AS k", "id * 2 AS w")
    for how, n in (("inner", 273), ("left", 3_000), ("left_anti", 2_727)):
        for sieve in (1 << 20, 4):
            monkeypatch.setattr(common, "SIEVE", sieve)
            out = common.join_few(docs, few, ["k"], how, 273, 16)
            assert out.count() == n == out.distinct().count()
            if how != "left_anti":
                assert out.where("w is not null and w = 2 * k").count() == 273
