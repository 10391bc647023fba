"""WARC archives with one Zstandard dictionary, written and read by executors.

An archive is a skippable frame that holds the dictionary, then one frame for each record. Equal payloads
are stored once: the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidevec.llm.common import cut, delete, join_few, only, prepare, shared_dir

#: Fixed values of the format: magic number of the frame with the dictionary, profile of revisits.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that the dictionary is trained on (by hash of page_id, at most about so many) and bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 16_384, 112_640
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1_000_000_000
READ_BYTES = 1 << 20
LEVEL = 3
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id)) if page_id is not None else uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with the payload, or a revisit record (no payload) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def about(date: str) -> bytes:
    """The warcinfo record that leads an archive."""
    block = b"software: tidevec\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None)}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields of a record, its HTTP header and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples their end as raw content; nothing without samples."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    head = stream.read(8)
    if head[:4] != SKIPPABLE:
        raise ValueError("no dictionary frame")
    d = _dictionary(stream.read(int.from_bytes(head[4:], "little")))
    decompressor = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    data = stream.read(READ_BYTES)
    while data:
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(READ_BYTES)):
                raise ValueError("an archive is cut short")
            out.append(frame.decompress(data))
            data = frame.unused_data
        yield b"".join(out)
        data = data or stream.read(READ_BYTES)


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (bytes; null: empty) and refers_to: the page with the largest id of equal payload, null for that page.

    Payloads under min_bytes refer to nothing. Null ids are smaller than others; if all ids of a payload
    are null, none refers to another. Rows of the largest id itself, if repeated, are all responses.
    """
    p = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("_sha", F.sha1("html"))
    same = p.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    same = same.where("_n > 1 and _last is not null").select("_sha", "_last")
    number = same.count()
    p = join_few(p, cut(same, number), ["_sha"], "left", number, 80)
    other = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return p.select("page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, directory: str, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html, ...) as archives in directory (a URI that executors share); path, records, bytes of each.

    A warcinfo record leads each archive; it is not counted. date is that of all records, by default that of the call.

    Each attempt of a task writes files of its own name and reports them when they are complete, so files of
    lost attempts are never listed. The list is kept in the shared folder: archives are written once.
    """
    spark, pages = pages.sparkSession, only(pages, "page_id", "url", "html")
    prepare(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    total = pages.count()
    share = int(min(1.0, SAMPLE_RECORDS / max(1, total)) * 1_000_000) + 1
    sample = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < share).select("page_id", "url", F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("html"))
    raw = build_dictionary([record(r.page_id, r.url, bytes(r.html or b""), None, date) for r in sample.limit(2 * SAMPLE_RECORDS).collect()])
    table = spark.sparkContext.broadcast(raw)
    directory = directory if "://" in directory or directory.startswith("file:") else f"file://{directory}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(table.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d).compress if d else zstandard.ZstdCompressor(level=LEVEL).compress
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        name = out = None
        done: list = []
        records = size = 0
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, records, size = f"{root}/part-{uuid.uuid4()}.warc.zst", 0, 0
                    out = store.open_output_stream(name, compression=None)
                    out.write(SKIPPABLE + len(table.value).to_bytes(4, "little") + table.value + compress(about(date)))
                frame = compress(record(page_id, url, html, refers, date))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(with_references(pages, min_bytes).mapInArrow(run, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, directory: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in archives(path, ...) of directory."""
    directory = directory if "://" in directory or directory.startswith("file:") else f"file://{directory}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(directory)

        def batch(rows: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        fields, http, payload = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                            raise ValueError("a payload differs from its digest")
                        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    return archives.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a new folder in the shared one, read them back and delete it; a row for each row of pages."""
    directory = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    rows = cut(read_archives(write_archives(pages, directory, min_bytes), directory))
    delete(spark, directory)
    return rows
