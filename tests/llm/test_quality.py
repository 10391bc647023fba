import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, odd_documents

from tidevec.llm import quality
from tidevec.llm.common import is_training

DATA = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def brute(scores, mean, strength, path_strength):
    """Scores from document log odds by plain loops."""
    p = {r.doc_id: 1 / (1 + np.exp(-r._logit)) for r in scores}
    hosts, paths = {}, {}
    for r in scores:
        hosts.setdefault(r._host, []).append(p[r.doc_id])
        paths.setdefault(r._path, []).append(p[r.doc_id])
    out = {}
    for r in scores:
        h, q = hosts[r._host], paths[r._path]
        host = (sum(h) - p[r.doc_id] + strength * mean) / (len(h) - 1 + strength)
        path = min(max((sum(q) - p[r.doc_id] + path_strength * host) / (len(q) - 1 + path_strength), 1e-3), 1 - 1e-3)
        out[r.doc_id] = 1 / (1 + np.exp(-(r._logit + np.log(path / (1 - path)) - np.log(mean / (1 - mean)))))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_accuracy_and_scores(spark, tables):
    docs, labels = tables
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    fold = {r.doc_id for r in labels.where(~is_training(labels.doc_id)).collect()}
    y = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["doc_id"] in fold}
    good, bad = [out[i].kept for i in y if y[i] == 1], [out[i].kept for i in y if y[i] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    scores = quality.document_scores(docs, quality.fit(docs, labels))
    want = brute(scores.collect(), *quality.sites(scores)[1])
    assert all(abs(out[i].score - want[i]) < 1e-6 for i in want)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in out if out[i].kept}


def test_sites_of_many_kinds_shrink(spark):
    rows = [(i, "x", "https://a.org/good/1") for i in range(400)] + [(1000, "x", "b.org"), (1001, "x", None), (1002, "x", "https://a.org/bad?q")]
    scores = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scores = scores.select("doc_id", *quality.site(scores.source)).selectExpr("*", "CASE WHEN _host = 'a.org' THEN 3D ELSE -3D END AS _logit")
    table, (mean, strength, path_strength) = quality.sites(scores)
    rows = {r._path: r for r in table.collect()}
    assert set(rows) == {"a.org/good", "a.org/bad", "b.org/", "/"} and rows["a.org/good"]._host_n == 401
    assert 0.9 < mean < 0.96
    assert all(quality.STRENGTH[0] <= x <= quality.STRENGTH[1] for x in (strength, path_strength))


def by_path(spark, rates, n=60):
    """Scores of URL sources: n documents of each path, of which a share is good."""
    rows = [(i, f"https://h{h}.org/p{p}/{i}?q", 4.0 if i < rate * n else -4.0) for h, paths in enumerate(rates) for p, rate in enumerate(paths) for i in range(n)]
    scores = spark.createDataFrame(rows, "doc_id long, source string, _logit double")
    return scores.select("doc_id", *quality.site(scores.source), "_logit")


def test_the_strength_of_paths_is_fitted(spark):
    """Paths that differ within their host count for themselves; paths alike shrink to their host; without paths there is no path level."""
    _, (_, _, apart) = quality.sites(by_path(spark, [(0.1, 0.9), (0.2, 0.8), (0.9, 0.05)]))
    _, (_, _, some) = quality.sites(by_path(spark, [(0.3, 0.6), (0.4, 0.7), (0.5, 0.2)]))
    _, (_, _, alike) = quality.sites(by_path(spark, [(0.5, 0.5), (0.4, 0.4), (0.7, 0.7)]))
    _, (_, _, single) = quality.sites(by_path(spark, [(0.1,), (0.9,)]))
    assert apart == quality.STRENGTH[0] < some < 100 < alike == single == quality.STRENGTH[1]


def test_clashing_names_types_and_repeated_ids(spark):
    odd = "doc_id int, text string, source string, _host string, _path string, _logit double, _host_sum string, _path_n int, TEXT string, Doc_ID int"
    rows = [(i % 25, f"word{i} and words", f"s{i % 3}", "h", "p", 7.0, "x", 3, "T", 9) for i in range(50)]
    df = spark.createDataFrame(rows, odd)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(25)], "doc_id int, quality int, toxic int")
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns
    got = out.collect()
    assert set(map(tuple, got)) <= set(rows) and len(got) == quality.classify(df, labels).where("kept").count()
    assert dict(quality.classify(df, labels).dtypes)["doc_id"] == "int"


def test_salted_join_gives_the_same(spark, tables, monkeypatch):
    docs, labels = tables[0].limit(300), tables[1]
    want = sorted((r.doc_id, round(r.score, 9)) for r in quality.classify(docs, labels).collect())
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert sorted((r.doc_id, round(r.score, 9)) for r in quality.classify(docs, labels).collect()) == want


def test_odd_documents(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, None), (3, None, None), (1, 1, 1)], LABELS)
    assert len(quality.classify(df, labels).collect()) == len(odd_documents())
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept for r in quality.classify(df, none).collect())
    assert quality.keep_good(df, none).count() == len(odd_documents())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.classify(empty, none).collect() == [] and quality.keep_good(empty, none).collect() == []


def test_pages_of_a_host_share_its_rate(spark):
    from tidevec.llm.quality_rules import apply_rules

    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "few words" if i % 2 else good, f"https://{'bad' if i % 2 else 'good'}.example/page/{i}?x=1#y") for i in range(40)]
    rows += [(40, good, "bad.example"), (41, good, None), (42, good, "")]
    out = {r.doc_id: r.host_fail_rate for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len({out[i] for i in range(1, 40, 2)} | {out[40]}) == 1 and len({out[i] for i in range(0, 40, 2)}) == 1
    assert out[40] > 0.7 and out[0] < 0.3
