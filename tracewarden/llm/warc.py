"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``; a bundle is the concatenation of its
frames and a footer: a skippable frame with a seek table (compressed and plain size of each frame, then the frame
count, a flag byte and the magic number of the public seekable format). The index maps every record to
(bundle, frame, offset in the plain frame, length), so one record costs one frame. Bundles of about ``bundle_bytes``
are rows of a Parquet table: any store that Spark reads and writes can hold them, and a lost executor's bundles are
written again by the task's retry.

Records with equal payloads (SHA-1 and length) of at least ``least_bytes`` are stored once: the one with the largest
id is the response, the others are revisit records that name it.

Edge cases: a null payload is empty; a null url has no target header; line breaks in urls are percent-encoded; rows
that repeat the largest id are responses too; rows with null ids revisit an equal payload with an id, and are
responses where all ids are null; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pick

SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E  # fixed values of the seekable format
FRAME_BYTES, BUNDLE_BYTES, LEAST_BYTES = 256 << 10, 16 << 20, 1000
SALTS = 16
EPOCH = "1970-01-01T00:00:00Z"

BUNDLE = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("index", T.ArrayType(T.StructType([T.StructField("record_id", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))),
])
RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()),
    ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("bundle", T.StringType()), ("frame", T.IntegerType()), ("offset", T.LongType()), ("length", T.LongType()),
)])


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(page_id, url, payload: bytes, digest: str, refers_to=None, size: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to``) carries no payload, but its digest and ``size``."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size if revisit else len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Fields and payload of the record at ``at``, and where the next begins."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(fields["Content-Length"])
    body = data[start:end]
    http_end = body.index(b"\r\n\r\n") + 4
    fields["payload"] = body[http_end:]
    http = dict(line.split(": ", 1) for line in body[: http_end - 4].decode().split("\r\n")[1:])
    fields["payload_bytes"] = int(http["Content-Length"])
    return fields, end + 4


class Bundler:
    """Collects records into frames; ``close`` returns the bundle and its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.plain: list[int] = []
        self.open: list[bytes] = []
        self.held = self.size = 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, key: str, record: bytes) -> None:
        self.index.append((key, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.open:
            self.frames.append(self.packer.compress(b"".join(self.open)))
            self.plain.append(self.held)
            self.size += len(self.frames[-1])
            self.open, self.held = [], 0

    def close(self) -> tuple[bytes, list]:
        self._flush()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.plain)) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIP_MAGIC, len(table)) + table, self.index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEK_MAGIC or flags & 0x80:
        raise ValueError("no seek table of the kind written here")
    out, at, entry = [], 0, len(data) - 9 - 8 * n
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, entry + 8 * k)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def classify(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set for revisits.

    Groups are aggregated before any shuffle (one small row for each); only groups of two or more come back to the
    pages, by a join on salted digests, so that a hot payload is spread.
    """
    base = pick(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= least_bytes
    groups = base.filter(long).groupBy("digest", F.length("payload").alias("size")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = base.withColumn("size", F.when(long, F.length("payload"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(groups, ["digest", "size", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archive(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles (bundle, data, index), written to the shared folder and read back from there."""

    def run(batches):
        from pyspark import TaskContext

        part, k, bundler = TaskContext.get().partitionId(), 0, Bundler(frame_bytes)

        def row() -> pa.RecordBatch:
            data, index = bundler.close()
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            rows = [dict(zip(("record_id", "frame", "offset", "length"), x)) for x in index]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:04d}"]), pa.array([data], pa.binary()), pa.array([rows], kind)], names=BUNDLE.names)

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page, refers, raw = page.as_py(), refers.as_py(), payload.as_py()
                bundler.add(record_id(page), write_record(page, url.as_py(), raw, digest.as_py(), refers, len(raw)))
                if bundler.size >= bundle_bytes:
                    yield row()
                    k, bundler = k + 1, Bundler(frame_bytes)
        if bundler.index:
            yield row()

    return cut(records.mapInArrow(run, BUNDLE), "warc")


def read_archive(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, a frame at a time, with its place."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("bundle"), batch.column("data")):
                name, data = name.as_py(), data.as_py()
                table = seek_table(data)
                for frame in range(len(table)):
                    yield _records(name, frame, read_frame(data, table, frame))

    def _records(name: str, frame: int, plain: bytes) -> pa.RecordBatch:
        rows, at = [], 0
        while at < len(plain):
            f, end = read_record(plain, at)
            page, refers = f.get("X-Page-Id"), f.get("X-Refers-To-Page")
            digest = base64.b32decode(f["WARC-Payload-Digest"].partition(":")[2]).hex()
            if f["WARC-Type"] == "response" and hashlib.sha1(f["payload"]).hexdigest() != digest:
                raise ValueError(f"payload of {f['WARC-Record-ID']} differs from its digest")
            rows.append((None if page is None else int(page), f.get("WARC-Target-URI"), f["WARC-Type"], None if refers is None else int(refers), None if refers is not None else f["payload"], f["payload_bytes"], digest, name, frame, at, end - at))
            at = end
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=RECORD.names)

    return bundles.select("bundle", "data").mapInArrow(run, RECORD)


def fetch(bundles: DataFrame, page_ids: list[int]) -> DataFrame:
    """(page_id, record) of the given pages by random access: only their frames are unpacked."""
    wanted = {record_id(p): p for p in page_ids}
    spots = bundles.select("bundle", "data", F.filter("index", lambda x: x["record_id"].isin(list(wanted))).alias("index")).filter(F.size("index") > 0)

    def run(batches):
        for batch in batches:
            for data, index in zip(batch.column("data"), batch.column("index")):
                data = data.as_py()
                table = seek_table(data)
                rows = [(wanted[x["record_id"]], read_frame(data, table, x["frame"])[x["offset"] : x["offset"] + x["length"]]) for x in index.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["page_id", "record"])

    return spots.mapInArrow(run, "page_id long, record binary")


def frames_of(data: bytes) -> Iterator[bytes]:
    table = seek_table(data)
    return (read_frame(data, table, k) for k in range(len(table)))
