"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Each archive begins with a skippable frame (0x184D2A5D) that holds its dictionary, trained on a bounded share of the records
of that archive; each record is a frame of its own. Archives are files in the shared folder, written by the
tasks under names of their own; a manifest, which only finished tasks add to, says which ones count, so files
of lost or repeated tasks are never read.

Of pages with equal payloads (of ``min_bytes`` at least) the one with the largest page_id is stored as response,
the others revisit it; rows that share that page_id too are all responses. A null html is an empty payload, a null page_id never
revisits. Empty tables give no archive. An archive closes after ``ARCHIVE_BYTES``, so a task holds about that much
and one page. Too few records for training get no dictionary and no skippable frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.llm.common import text_of, written
from barscope.session import scratch_path

ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
# Frame magics of the format, and the profile of records that only refer to an equal payload.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses).

    Digests are joined without payloads; only what revisits is then looked up by page, so a group of equal payloads
    never meets in one task.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    keys = p.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha").where("page_id IS NOT NULL")
    groups = keys.groupBy("sha").agg(F.max("page_id").alias("last"), F.min("page_id").alias("low")).where("low <> last")
    late = keys.join(groups, "sha").where("page_id <> last").select("page_id", "sha", "last").distinct()
    late = late.select(F.col("page_id").alias("__p"), F.col("sha").alias("__s"), F.col("last").alias("refers_to"))
    return p.join(late, (F.col("page_id") == F.col("__p")) & (F.col("sha") == F.col("__s")), "left").drop("__p", "__s")


def _urn(page) -> str:
    return f"<urn:page:{'unknown' if page is None else page}>"


def record(page, url, payload: bytes, sha: bytes, refers) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or _urn(page)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers is None else http
    more = "" if refers is None else f"WARC-Refers-To: {_urn(refers)}\r\nWARC-Profile: {PROFILE}\r\n"
    digest = base64.b32encode(sha).decode()
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers is None else 'revisit'}\r\nWARC-Record-ID: {_urn(page)}\r\n"
        f"WARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n{more}WARC-Payload-Digest: sha1:{digest}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: 64 << 10] for r in records[::step]]
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, level=3)
    except zstd.ZstdError:  # too little to learn from
        trained = None
    packer = zstd.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    out = []
    if trained is not None:
        raw = trained.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    return b"".join(out + [packer.compress(r) for r in records])


def records_of(content: bytes):
    """(headers, HTTP head and payload) of each record of an archive."""
    import zstandard as zstd

    trained, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        trained, at = zstd.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    packed = memoryview(content)[at:]
    data = zstd.ZstdDecompressor(dict_data=trained).stream_reader(packed, read_across_frames=True).readall()
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4 : at]
        at += 4


def _write_part(folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        held, size = [], 0

        def flush():
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(archive(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "refers_to"))):
                held.append(record(row[0], row[1], row[2].encode(), row[3], row[4]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives into ``folder``; gives the manifest (file, records)."""
    rows = marked(pages, min_bytes).select("page_id", "url", "payload", "sha", "refers_to")
    return written(rows.mapInArrow(_write_part(folder), "file string, records long"), "warc-manifest")


def _read_part(batches):
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for h, body in records_of(content.as_py()):
                head, _, payload = body.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                digest = h["warc-payload-digest"].partition(":")[2]
                if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"digest of {h['warc-record-id']} differs")
                page = lambda x: None if x is None or "unknown" in x else int(x.strip("<>").rpartition(":")[2])
                refers = page(h.get("warc-refers-to"))
                out.append((page(h["warc-record-id"]), int(fields["Content-Length"]), digest, h["warc-type"], refers))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in the manifest."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    files = files.join(manifest.select("file"), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("content").mapInArrow(_read_part, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    return read(spark, folder, write(pages, folder, min_bytes))
