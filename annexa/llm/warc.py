"""Dictionary-compressed WARC archives (operator 4).

A Zstandard dictionary is built from a bounded sample of the records and
embedded, as a leading skippable frame, in every archive; each record is then
one frame of its own, so archives can be read from any record on. Equal
payloads are archived once: the record with the smallest page_id is a response,
the others are revisits that name it.

Every task writes its archives (``.warc.zst``, at most ``archive_bytes`` of raw
records each) straight into a shared folder under names of their own; the
manifest holds the names that finished tasks report, so lost or repeated
attempts leave no trace in it. Reading back streams record by record.

Cases: null html is an empty payload; payloads under ``min_bytes`` are all
responses; rows repeated whole (same page_id and payload) are responses each;
a null page_id is kept, written as "null" and comes last among equal payloads (a
revisit, or a response if no equal payload has an id); very long payloads are
records like others; an empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir

#: The skippable frame's magic number and the page's place in a record.
DICT_FRAME = 0x184D2A5D
EPOCH = "1970-01-01T00:00:00Z"


def firsts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """digest (hex SHA-1), first (smallest page_id), n: the payloads that several records share."""
    payload = F.coalesce("html", F.lit(""))
    d = pages.where(F.octet_length(payload) >= min_bytes).select("page_id", F.sha1(payload).alias("digest"))
    return d.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")


def marked(pages: DataFrame, min_bytes: int = 0, hot_rows: int = 100_000) -> DataFrame:
    """page_id, url, html, first: null for a response, else the page that the record revisits.

    Payloads of more than ``hot_rows`` records are at most one for so many
    records, so they are broadcast; their pages then stay out of the join by
    digest, in which they would meet in one task.
    """
    shared = cut(firsts(pages, min_bytes))
    hot = shared.where(F.col("n") > hot_rows).select(F.col("digest").alias("h"), F.col("first").alias("hot"))
    rest = shared.where(F.col("n") <= hot_rows).select(F.col("digest").alias("r"), "first")
    payload = F.coalesce("html", F.lit(""))
    p = pages.withColumn("digest", F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)))
    p = p.join(F.broadcast(hot), F.col("digest") == F.col("h"), "left")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    p = p.withColumn("digest", F.when(F.col("hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(alone))
    p = p.join(rest, F.col("digest") == F.col("r"), "left").withColumn("first", F.coalesce("hot", "first"))
    return p.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("first"))


def build_dictionary(pages: DataFrame, samples: int = 256, size: int = 65_536) -> bytes:
    """A dictionary from ``samples`` records: 8 slices of 2,048 characters, spread over the whole record, of each."""
    # keys first: what the driver gathers is the slices, however many partitions there are
    keys = pages.where("html <> ''").select("page_id", F.xxhash64("page_id").alias("k")).orderBy("k").limit(samples).select("page_id").distinct()
    slices = F.expr("transform(sequence(0, least(8, int(ceil(length(html) / 2048))) - 1), i -> substring(html, 1 + int(i * bigint(length(html)) / least(8, int(ceil(length(html) / 2048)))), 2048))")
    pick = pages.where("html <> ''").join(F.broadcast(keys), "page_id").select("page_id", slices.alias("s")).orderBy("page_id", "s").limit(samples)
    parts = [x.encode() for r in pick.collect() for x in r["s"]]
    try:
        return zstandard.train_dictionary(size, parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too few records to train on
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its length and digest."""
    name = lambda x: f"<urn:page:{x}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name('null' if page_id is None else page_id)}", f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    body = payload
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives and returns their manifest: path, records, bytes."""
    dictionary = build_dictionary(pages)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def write(rows):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        kind = zstandard.DICT_TYPE_FULLDICT
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind)) if dictionary else zstandard.ZstdCompressor(level=3)
        out, path, done, n, raw = None, "", [], 0, 0
        for rb in rows:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, n, raw = fs.open_output_stream(path), 0, 0
                    if dictionary:
                        out.write(struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary)
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rec = record(page_id, url, payload, digest, first)
                out.write(coder.compress(rec))
                n, raw = n + 1, raw + len(rec)
                if raw >= archive_bytes:
                    out.close()
                    done.append((path, n, raw))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, raw))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(marked(p, min_bytes).mapInArrow(write, "path string, records long, bytes long"))


def parse_records(stream):
    """(headers, payload) of every record of one archive."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_FRAME:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]), dict_type=zstandard.DICT_TYPE_FULLDICT)
        head = b""
    coder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    waiting = head
    while True:
        frame = coder.decompressobj()
        parts = []
        while not frame.eof:
            block = waiting or stream.read(1 << 16)
            waiting = b""
            if not block:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(frame.decompress(block))
        waiting = frame.unused_data
        data = io.BytesIO(b"".join(parts))
        if data.readline().strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {}
        while line := data.readline().strip():
            k, _, v = line.decode().partition(":")
            headers[k] = v.strip()
        payload = data.read(int(headers["Content-Length"]))
        if data.read() != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, payload


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, read from the archives."""
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])

    def read(rows):
        fs, _ = _filesystem(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)
        for rb in rows:
            for path in rb.column("path").to_pylist():
                out = []
                with fs.open_input_stream(path) as f:
                    for h, payload in parse_records(f):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                        out.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], int(h["X-Payload-Bytes"]), digest, h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                        if len(out) >= 5000:
                            yield batch(out)
                            out = []
                yield batch(out)

    spread = manifest.select("path").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in ``folder`` (by default under spark.checkpoint.dir) and reads them back."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, min_bytes), folder)
