import hashlib

import pyarrow.parquet as pq
from cases import SCHEMA, odd_documents

from tidevec.llm import common, substring
from tidevec.llm.substring import drop_repeats, report

DATA = "/root/testdata/sf0.001"


def brute(rows, k=20):
    first, out = {}, {}
    docs = {(-(1 << 63) if i is None else i): (t or "").encode().split() for i, t in rows}
    for i in sorted(docs):
        w = docs[i]
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first.setdefault(tuple(w[j : j + k]), (i, j)) != (i, j):
                gone[j : j + k] = [True] * k
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def got(df):
    return {-(1 << 63) if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_odd_documents(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, SCHEMA)
    out = report(df)
    assert out.count() == len(rows)
    want = brute([r[:2] for r in rows])
    assert got(out) == want
    cut = drop_repeats(df)
    assert cut.columns == df.columns
    kept = {-(1 << 63) if r.doc_id is None else r.doc_id: r.text for r in cut.collect()}
    for i, t in kept.items():
        assert hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == want[i][2]
    assert {i for i in want if i not in kept} == {i for i, (n, g, _) in want.items() if n and n == g}


def test_table(spark):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got(report(spark.read.parquet(f"{DATA}/documents.parquet"))) == brute([(r["doc_id"], r["text"]) for r in t])


def test_many_ranges_and_flushes(spark, monkeypatch):
    """Many small partitions, flushes and ranges, and a join beyond broadcast, give the same as few large ones."""
    for name, value in (("RANGE_ANCHORS", 40), ("GROUP_ANCHORS", 50), ("FLUSH_BYTES", 3_000)):
        monkeypatch.setattr(substring, name, value)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got(report(spark.read.parquet(f"{DATA}/documents.parquet").repartition(16))) == brute([(r["doc_id"], r["text"]) for r in t])
    rows = odd_documents()
    assert got(report(spark.createDataFrame(rows, SCHEMA))) == brute([r[:2] for r in rows])


def test_the_sketch_loses_none_and_rules_most_out(spark):
    """All repeated anchors are estimated as such, and few others."""
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    places, all_ = {}, set()
    for r in t:
        words = (r["text"] or "").encode().split()
        if len(words) >= substring.WINDOW:
            at, g = substring.anchors(common.WORDS.array(words))
            for i in set(at.tolist()):
                places.setdefault(int(g[i]), []).append((r["doc_id"], i))
                all_.add((r["doc_id"], i))
    want = {x for v in places.values() if len(v) > 1 for x in v}
    scratch = common.Scratch(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id as _doc", "xxhash64(text) as _twin", "text")
    rows = substring.estimated(substring.anchor_store(docs, scratch), 8).collect()
    found = {(r["_doc"], int(x)) for r in rows for x in substring._places(r["starts"])}
    scratch.close()
    assert want and want <= found and len(found - want) <= 0.01 * len(all_ - want)


def test_repeated_ids_types_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x", 1, "a", 5, 6), (2, text + " end", "y", 2, "b", 5, 6), (2, text + " other", "z", 2, "c", 5, 6), (2, text + " other", "z", 2, "c", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id int, text string, TEXT string, Doc_ID int, _doc string, _twin int, _starts int")
    out = drop_repeats(df)
    assert out.columns == df.columns
    assert sorted((r[0], r[1].strip(), r[2], r[4]) for r in out.collect()) == [(1, text, "x", "a"), (2, "end", "y", "b"), (2, "other", "z", "c"), (2, "other", "z", "c")]
    assert dict(report(df).dtypes)["doc_id"] == "int" and report(df).count() == 4


def test_empty(spark):
    assert report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
