"""WARC output: monolithic archives, a gzip normaliser with sidecar index, and the reader.

Writing tasks put their records into one gzip stream a file. The normaliser inflates such a stream
once from front to back, frames the records by their Content-Length, rewrites every record as a gzip
member of its own and writes a sidecar index (offset, length, payload bytes, record id) so that any record can be
read with one ranged read. Files get their final name by a move and are found through a written
manifest only, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions, slices, work_path, written

LEVEL = 1
CHUNK = 1 << 20
INDEX = struct.Struct("<qqq16s")  # offset, compressed length, payload bytes, record id
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6b1f8f0e-6c8e-5f0a-9d61-0d8c1f6f7a11")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit names the record it repeats and carries no block. A record is named by
    page_id and payload, so rows that share a page_id share a name only if they are copies; without page_id
    there is no such header, and the record is named by its URL and payload."""
    name = f"{url} {payload_digest}" if page_id is None else f"{page_id} {payload_digest}"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, name)}>".encode(),
        f"WARC-Date: {DATE}".encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        f"WARC-Payload-Digest: sha1:{payload_digest}".encode(),
        *([] if page_id is None else [f"X-Page-ID: {page_id}".encode()]),
        f"X-Payload-Bytes: {len(payload)}".encode(),
    ]
    block = payload
    if refers_to is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(NAMESPACE, f"{refers_to} {payload_digest}")}>".encode(),
            f"X-Refers-To-Page-ID: {refers_to}".encode(),
        ]
        block = b""
    head += [b"Content-Type: text/html", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)


class Frames:
    """Cuts a byte stream, fed in pieces, into whole records."""

    def __init__(self):
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) >= 0:
            head = bytes(self.buffer[at:end])
            size = int(fields(head)[b"Content-Length"])
            stop = end + 4 + size + 4
            if stop > len(self.buffer):
                break
            yield bytes(self.buffer[at:stop])
            at = stop
        del self.buffer[:at]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one member or several, in pieces of CHUNK bytes at most, however well the
    input was compressed."""
    inflate = zlib.decompressobj(31)
    while piece := source.read(CHUNK):
        while True:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            data = inflate.decompress(piece, CHUNK)
            if data:
                yield data
            piece = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if not piece and (inflate.eof or len(data) < CHUNK):
                break


def normalise(source, target, index) -> tuple[int, int]:
    """Inflates the single gzip stream ``source`` once; writes a member for each record to ``target``
    and a row of ``INDEX`` for each to ``index``. Returns the records and the bytes written."""
    frames, at, n = Frames(), 0, 0
    for data in inflated(source):
        for rec in frames.feed(data):
            deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = deflate.compress(rec) + deflate.flush()
            target.write(member)
            head = fields(rec[: rec.index(b"\r\n\r\n")])
            name = uuid.UUID(head[b"WARC-Record-ID"].decode().strip("<>")).bytes
            index.write(INDEX.pack(at, len(member), int(head[b"X-Payload-Bytes"]), name))
            at, n = at + len(member), n + 1
    if frames.buffer:
        raise ValueError("a record is cut short")
    return n, at


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, base = filesystem(folder)
    name, out, deflate, n = f"{base}/{uuid.uuid4().hex}", None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
    for b in slices(batches, "html"):
        if out is None:
            fs.create_dir(base, recursive=True)
            out = fs.open_output_stream(f"{name}.mono.gz.tmp", compression=None)
        cols = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to"))
        for page, url, html, sha, refers in zip(*cols, strict=True):
            out.write(deflate.compress(record(page, url, html or b"", sha, refers)))
            n += 1
    if out is None:
        return
    out.write(deflate.flush())
    out.close()
    with fs.open_input_stream(f"{name}.mono.gz.tmp", compression=None) as src, fs.open_output_stream(f"{name}.warc.gz.tmp", compression=None) as dst, fs.open_output_stream(f"{name}.idx.tmp", compression=None) as idx:
        found, size = normalise(src, dst, idx)
    if found != n:
        raise ValueError(f"wrote {n} records, the normaliser found {found}")
    fs.delete_file(f"{name}.mono.gz.tmp")
    fs.move(f"{name}.idx.tmp", f"{name}.idx")
    fs.move(f"{name}.warc.gz.tmp", f"{name}.warc.gz")
    leaf = name.rsplit("/", 1)[1]
    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{leaf}.warc.gz"], "index_file": [f"{folder}/{leaf}.idx"], "records": [n], "bytes": [size]})


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the manifest.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response
    and the others revisit it; smaller payloads are all responses. A null html is an empty payload.
    Repeated rows with the smallest page_id are all responses. A row without
    page_id is a response, nothing revisits it, and it is read back without one. Other columns are ignored; an empty table writes an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    keys = rows.select("page_id", "sha", F.length("html").alias("size")).where(F.col("size") >= min_bytes)
    # Only groups of two or more take part in the join; the partial aggregate shrinks hot groups first.
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    revisits = keys.join(first, "sha").where("page_id <> first").select("page_id", "sha", "first").distinct()
    revisits = written(revisits, "revisits")  # a table, so that Spark knows its size: no payload is shuffled where it is small
    typed = rows.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))
    manifest = typed.mapInArrow(_with_digest, "page_id long, url string, html binary, payload_digest string, refers_to long").mapInArrow(partial(_write, folder), "file string, index_file string, records long, bytes long")
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.parquet(path)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shas = pa.array([digest(x) for x in b.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("html"), shas, b.column("refers_to")], ["page_id", "url", "html", "payload_digest", "refers_to"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, index_file in zip(b.column("file").to_pylist(), b.column("index_file").to_pylist(), strict=True):
            fs, path = filesystem(file)
            with fs.open_input_stream(filesystem(index_file)[1], compression=None) as f:
                rows = list(INDEX.iter_unpack(f.read()))
            out: list[tuple] = []
            held = 0
            with fs.open_input_file(path) as f:
                for offset, length, size, name in rows:
                    f.seek(offset)
                    rec = zlib.decompress(f.read(length), 31)
                    end = rec.index(b"\r\n\r\n")
                    h = fields(rec[:end])
                    kind = h[b"WARC-Type"].decode()
                    block = rec[end + 4 : -4]
                    sha = h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if uuid.UUID(h[b"WARC-Record-ID"].decode().strip("<>")).bytes != name:
                        raise ValueError("the index does not match its file")
                    if kind == "response" and (digest(block) != sha or len(block) != size):
                        raise ValueError(f"record of page {h.get(b'X-Page-ID')!r} is damaged")
                    refers = h.get(b"X-Refers-To-Page-ID")
                    page = h.get(b"X-Page-ID")
                    out.append((None if page is None else int(page), h.get(b"WARC-Target-URI", b"").decode(), kind, size, sha, int(refers) if refers else None, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield _records(out)
                        out, held = [], 0
            if out:
                yield _records(out)


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest, through their indexes, each checked by its digest."""
    n = partitions(manifest.sparkSession)
    return manifest.select("file", "index_file").repartition(n, "file").mapInArrow(_reader, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary")


def dump(records: list[bytes]) -> bytes:
    """A monolithic gzip stream of records (for tests and small files)."""
    out = io.BytesIO()
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for r in records:
        out.write(deflate.compress(r))
    out.write(deflate.flush())
    return out.getvalue()
