"""Each stage of the pipeline, on what the stage before it kept, against brute force."""

import hashlib
import os

import pyarrow.parquet as pq
import pytest
from cases import SCHEMA, odd_documents
from test_near_dup import brute as near
from test_packing import check
from test_substring import brute as repeats
from test_texts import brute_hits

import corpus_pipeline
from tidevec.llm import quality
from tidevec.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into and came out of each stage, by name."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(t):
    return hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()


def test_columns(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_quality(spark, stages):
    before, after = stages["quality classifier"]
    kept = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if i in kept}
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    good = [i in kept for i in label if label[i] == 1]
    assert sum(good) >= 0.95 * len(good) and len(kept) < before.count()


def test_near_dedup(stages):
    before, after = stages["MinHash near-dedup"]
    all_ = texts(before)
    want = near(list(all_.items()), 5)
    assert texts(after) == {i: t for i, t in all_.items() if want[i][1] == i}


def test_substrings(stages):
    before, after = stages["substring dedup"]
    want = {i: x for i, x in repeats(list(texts(before).items())).items() if x[0] == 0 or x[1] < x[0]}
    got = texts(after)
    assert {i: words(t) for i, t in got.items()} == {i: x[2] for i, x in want.items()}
    assert all(got[i] == t for i, t in texts(before).items() if i in want and want[i][1] == 0)


def test_benchmark(stages):
    before, after = stages["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    all_ = texts(before)
    want = brute_hits(list(all_.items()), items)
    got = texts(after)
    assert set(got) == {i for i, x in want.items() if x[2] < 2 and (x[0] == 0 or x[1] < x[0])}
    assert all(got[i] == all_[i] for i in got if want[i][1] == 0)


def test_packing(stages):
    before, after = stages["best-fit packing"]
    sequences, least = check(after.collect(), texts(before))
    assert sequences <= least + 1


def test_run(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = sorted(map(tuple, stages["best-fit packing"][1].select(*columns).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(*columns).collect())) == want


def odd_tables(spark, folder, rows):
    """Documents of rows with clashing extra columns, labels for some of them and a benchmark, as files."""
    names = "_host string, _path string, _logit string, _mask string, _items string, _doc string, _twin string, _starts string, c0 string, digest string"
    docs = spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{SCHEMA}, {names}")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("i1", "one two three four five six seven eight nine"), (None, "a b"), ("i2", None)], "item_id string, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{folder}/{name}.parquet")
    return docs.columns


@pytest.mark.parametrize("rows", [odd_documents(), []])
def test_odd_rows_and_clashing_names(spark, tmp_path, rows):
    named = lambda: {p for p in os.listdir(shared_dir(spark)) if p.startswith(("pipeline-", "tidevec-"))}
    before_all, columns = named(), odd_tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage-{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage-{k}")
        own = [c for c in columns if c != "text"]
        assert docs.select(own).exceptAll(before.select(own)).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    if rows:
        assert {None, 4, 5, 6} <= {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    assert named() == before_all
