"""WARC archives in Zstandard: writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame per
record.  The reader loads the dictionary from the leading frame, decodes record after record in pieces of bounded size, and
checks version line, mandatory headers, Content-Length against the block, the two line ends that close the record,
and the SHA-1 of payloads that are there.

Writing: records with equal payloads (SHA-256 and length) of at least ``min_bytes`` bytes are one response, that with the
largest page_id, and revisits, which carry the response's id, its digest and the HTTP headers but no payload.
Shorter payloads are always responses.  Groups are combined where they are read, so any number of equal payloads
is one row per task.  Each task writes one archive under a temporary name and then renames it, so a repeated
task replaces its own file.  A dictionary is trained for each archive on its first records.

The join of rows to their group is on the digest; a payload that a large share of the rows has is split by Spark's skew join.

Defined cases: a null html is an empty payload; a null page_id is written and read as null, and revisits the response of its group
like any other, but rows of which all page_ids are null are responses each, since there is no id to refer to; rows repeated with
the page_id of a group's response are responses too; an empty table writes no archive.  A payload of any length is one record,
of which a task holds a few copies at a time.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.llm.shared import place, written

#: Magic number of the dictionary's frame, and of a Zstandard frame (a compressed dictionary).
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Fixed date of records, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
DICT_BYTES, TRAIN_BYTES, TRAIN_RECORDS = 16_384, 1 << 20, 400
PIECE = 1 << 18
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def sha1_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC record: a response with its HTTP message, or a revisit with the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + sha1_digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        lines.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.insert(4, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or no bytes where the samples are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: Iterator[bytes]) -> int:
    """Writes the dictionary's frame and a frame per record to a binary stream; returns the number of records."""
    import zstandard

    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= TRAIN_BYTES or len(first) >= TRAIN_RECORDS:
            break
    words = dictionary(first)
    packed = zstandard.ZstdCompressor(level=9).compress(words) if words else b""
    out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True, write_checksum=True)
    n = 0
    for group in (first, records):
        for r in group:
            out.write(squeeze.compress(r))
            n += 1
    return n


def read_frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, read in pieces."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("archive without a leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise WarcError(f"leading frame has magic {magic:#x}")
    packed = stream.read(size)
    if len(packed) != size:
        raise WarcError("dictionary is cut short")
    words = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(ZSTD_MAGIC) else packed
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    rest = b""
    while True:
        if not rest:
            rest = stream.read(PIECE)
            if not rest:
                return
        frame, parts = engine.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = stream.read(PIECE)
                if not rest:
                    raise WarcError("last frame is cut short")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame can't be decoded: {e}") from e
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def parse_record(raw: bytes) -> Record:
    head, sep, body = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError("record doesn't open with its version")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError("header line without a colon")
        headers[name.strip()] = value.strip()
    if missing := [k for k in MANDATORY if k not in headers]:
        raise WarcError(f"record without {missing[0]}")
    n = headers["Content-Length"]
    if not n.isdigit() or len(body) != int(n) + 4 or not body.endswith(b"\r\n\r\n"):
        raise WarcError("Content-Length doesn't fit the block")
    return Record(headers, body[:-4])


def _page(urn: str | None):
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def page_row(r: Record) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a checked record."""
    kind = r.headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"record of type {kind}")
    http, sep, payload = r.block.partition(b"\r\n\r\n")
    fields = dict(line.partition(b":")[::2] for line in http.split(b"\r\n")[1:])
    size = int(fields.get(b"Content-Length", b"-1"))
    digest = r.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if not sep or size < 0:
        raise WarcError("HTTP message without its headers")
    if kind == "response" and (len(payload) != size or sha1_digest(payload) != digest):
        raise WarcError("payload doesn't fit its length and digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in r.headers):
        raise WarcError("revisit with a payload, or without what it refers to")
    return _page(r.headers["WARC-Record-ID"]), r.headers.get("WARC-Target-URI"), size, digest, kind, _page(r.headers["WARC-Refers-To"]) if kind == "revisit" else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _writer(folder: str):
    def run(batches):
        from pyspark import TaskContext

        held, rows = None, 0
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.zst"
        temp = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"

        def records():
            for batch in batches:
                for page_id, url, html, kind, refers in zip(*(c for c in batch.columns)):
                    yield record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), kind.as_py(), refers.as_py())

        it = records()
        held = next(it, None)
        if held is None:
            return
        with files.open_output_stream(temp, compression=None) as out:
            buffered = io.BufferedWriter(out, 1 << 20)
            rows = write_archive(buffered, _chain(held, it))
            buffered.flush()
        files.move(temp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["archive", "records"])

    return run


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives of pages (page_id, url, html) to ``folder``; returns archive, records (already run)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("sha"), F.octet_length(html).alias("n"))
    best = rows.groupBy("sha", "n").agg(F.max("page_id").alias("keep"))
    typed = rows.join(best, ["sha", "n"]).select(
        "page_id",
        "url",
        "html",
        F.when((F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("keep")), "response").otherwise("revisit").alias("kind"),
        F.col("keep").alias("refers"),
    )
    return written(pages.sparkSession, typed.mapInArrow(_writer(folder), "archive string, records long"), "warc-manifest")


def _reader(folder: str):
    def run(batches):
        files, _ = _filesystem(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, n = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in read_frames(stream):
                        out.append((*page_row(parse_record(raw)), path))
                        n += 1
                        if len(out) >= 5000:
                            yield _batch(out)
                            out = []
                if expected is not None and n != expected:
                    raise WarcError(f"{path} has {n} records, not {expected}")
                if out:
                    yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive of every record of the archives listed."""
    n = max(1, manifest.count())
    return manifest.select("archive", F.col("records").cast("long")).repartition(n).mapInArrow(_reader(folder), _READ)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = place(spark, "warc")
    return read_warc(write_warc(pages, folder, min_bytes), folder)
