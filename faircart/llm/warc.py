"""WARC archives in per-record Zstandard frames behind a leading dictionary frame.

An archive starts with one skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself Zstandard-compressed or plain; every record follows as a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
SUFFIX = ".warc.zst"
URN = "<urn:page:%s>"
#: An archive is closed after the record that brings it to this size, so that one file is a modest value to read.
ROLL_BYTES = 1 << 26
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if ``refers_to`` names another page."""
    block = HEAD % len(payload) + (b"" if refers_to is not None else payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", URN % page_id),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)
        fields.append(("WARC-Target-URI", safe))
    if refers_to is not None:
        fields += [("WARC-Refers-To", URN % refers_to), ("WARC-Profile", REVISIT)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; ValueError names what is wrong with it."""
    top, sep, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or header end")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {size}")
    block = rest[:size]
    if fields.get("warc-block-digest") not in (None, "sha1:" + base32_sha1(block)):
        raise ValueError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or len(lengths) != 1:
        raise ValueError("no HTTP header with a length")
    kind = fields["warc-type"]
    if kind == "response" and lengths[0] != len(payload):
        raise ValueError(f"payload of {len(payload)} bytes, HTTP says {lengths[0]}")
    if kind == "response" and fields.get("warc-payload-digest") != "sha1:" + base32_sha1(payload):
        raise ValueError("payload digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without its response")
    return {"fields": fields, "payload": payload, "payload_bytes": lengths[0]}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records; their own bytes where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or HEAD)[-size:].rjust(8, b" ")


class ArchiveWriter:
    """One archive: the dictionary frame, then a frame per record."""

    def __init__(self, out, raw: bytes, level: int = 3):
        plain = zstandard.ZstdCompressor(level=level).compress(raw)
        out.write(struct.pack("<II", SKIPPABLE, len(plain)) + plain)
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(level=level)
        self.packer, self.out, self.size = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True), out, 8 + len(plain)

    def add(self, record: bytes) -> None:
        frame = self.packer.compress(record)
        self.out.write(frame)
        self.size += len(frame)


def roll_archives(records: Iterator[bytes], create, roll: int = ROLL_BYTES, dict_size: int = 1 << 15, samples: int = 200) -> int:
    """Write ``records`` to as many archives as they need; the number of records.

    ``create(i)`` is a context that gives the stream of archive ``i``. The dictionary is made from the first
    records and leads every archive.
    """
    first = [r for _, r in zip(range(samples), records)]
    if not first:
        return 0
    raw, n, i = train_dictionary([r[:8192] for r in first], dict_size), 0, 0
    left = itertools.chain(first, records)
    while (r := next(left, None)) is not None:
        with create(i) as out:
            archive = ArchiveWriter(out, raw)
            while r is not None:
                archive.add(r)
                n += 1
                r = next(left, None) if archive.size < roll else None
        i += 1
    return n


def write_archive(records: Iterator[bytes], out) -> int:
    """Write all records to one archive ``out``; the number of records."""
    return roll_archives(records, lambda i: nullcontext(out), roll=1 << 62)


def read_frames(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of one archive: dictionary from the leading skippable frame, then a frame each."""
    view = memoryview(data)
    if len(view) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack_from("<II", view)
    if magic != SKIPPABLE or len(view) < 8 + size:
        raise ValueError("no dictionary frame")
    raw = bytes(view[8 : 8 + size])
    if raw[:4] == struct.pack("<I", ZSTD):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at = 8 + size
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def with_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` with each payload's response page.

    Only payloads that occur more than once are joined back; a hot payload's rows are split by
    adaptive execution. Rows with the response's own page_id stay responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
    groups = groups.agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    joined = rows.join(groups.drop("n"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL_BYTES) -> int:
    """Write ``pages(page_id, url, html)`` as archives of about ``roll`` bytes under ``path``; the number of records.

    ``path`` must be a URI that executors share. A task writes under names of its own attempt and renames
    its archives when all are whole; a repeated task replaces them, so a lost executor leaves no half archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        def records():
            for b in batches:
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    text = base64.b32encode(digest).decode()
                    yield build_record("null" if page_id is None else page_id, url, payload, text, refers_to, date)

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        drafts: list[str] = []

        def create(i: int):
            drafts.append(f"{folder}/_{uuid.uuid4().hex}")
            return store.open_output_stream(drafts[-1])

        n = roll_archives(records(), create, roll)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-%05d{SUFFIX}"
        for i, draft in enumerate(drafts):
            store.move(draft, name % i)
        # An attempt before this one may have met the rows in another order and left one archive more.
        i = len(drafts)
        while store.get_file_info(name % i).type != fs.FileType.NotFound:
            store.delete_file(name % i)
            i += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = with_responses(pages, min_bytes).mapInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``, read through Spark's own file reader.

    Every header, length and digest is validated; a faulty record fails the job with its
    archive's name. ``payload=False`` leaves the payload column out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SUFFIX).load(path).select("path", "content")
    schema = RECORD + (", payload binary" if payload else "")

    def number(urn: str | None):
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return None if text in ("", "null") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for i, data in enumerate(read_frames(content.as_buffer())):
                    try:
                        r = parse_record(data)
                    except ValueError as e:
                        raise ValueError(f"{name}, record {i}: {e}") from e
                    f = r["fields"]
                    row = (number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], number(f.get("warc-refers-to")))
                    row += (r["payload_bytes"], f["warc-payload-digest"].removeprefix("sha1:"))
                    rows.append(row + (r["payload"],) * payload)
                    held += len(data) if payload else 200
                    if held > 1 << 24:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` row written to archives in the shared folder and read back.

    Null html is an empty payload, and empty payloads are deduplicated like others. Rows that
    repeat the response's page_id are responses too; rows with a null page_id revisit a known
    page with the same payload, else they are responses. An empty table gives no rows.
    """
    path = scratch_path(spark, "warc")
    if not write_archives(table(spark, sf_dir, "pages"), path):
        return spark.createDataFrame([], RECORD).drop("url")
    return read_archives(spark, path, payload=False).drop("url")
