import base64
import hashlib
import io
import os

import pyarrow.parquet as pq

from tidevec.llm import common
from tidevec.llm.warc import archive_and_read, build_dictionary, parse, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, record_type string, refers_to string"


def brute(rows):
    best, count = {}, {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        last = best[html or ""]
        revisit = last >= 0 and i != last
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_pages(spark):
    rows = [(1, "http://a/x y\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 3_000_000), (None, "u", "<p>é</p>"), (None, "u", "alone"), (6, "u", "a\r\n\r\nb"), (6, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert got(archive_and_read(spark, df)) == brute(rows)


def test_table_and_files(spark, tmp_path):
    path = "/root/testdata/sf0.001/pages.parquet"
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(path).to_pylist()]
    archives = write_archives(spark.read.parquet(path), str(tmp_path))
    assert got(read_archives(archives, str(tmp_path))) == brute(rows)
    listed = {r.path for r in archives.collect()}
    assert listed == {str(p) for p in tmp_path.glob("*.warc.zst")}
    from tidevec.llm.warc import read_archive

    payloads = {}
    kinds = [[parse(raw)[0]["WARC-Type"] for raw in read_archive(io.BytesIO(open(p, "rb").read()))] for p in listed]
    assert all(k[0] == "warcinfo" and "warcinfo" not in k[1:] for k in kinds)
    assert sum(len(k) - 1 for k in kinds) == len(rows) == sum(r.records for r in archives.collect())
    for p in listed:
        for raw in read_archive(io.BytesIO(open(p, "rb").read())):
            fields, _, payload = parse(raw)
            if fields["WARC-Type"] == "response":
                payloads[int(fields["X-Page-ID"])] = payload
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(texts[i] == p for i, p in payloads.items())


def test_empty_and_small(spark):
    assert got(archive_and_read(spark, spark.createDataFrame([], SCHEMA))) == []
    assert build_dictionary([]) == b""
    assert build_dictionary([b"abc" * 10]) == b"abc" * 10


def test_clashing_names_and_a_join_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, f"u{i}", "same" if i % 3 else f"page {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id int, url string, html string, HTML string, _sha string, _last string")
    assert got(archive_and_read(spark, df)) == brute(rows)
    assert not [p for p in os.listdir(common.shared_dir(spark)) if p.startswith("warc-")]
