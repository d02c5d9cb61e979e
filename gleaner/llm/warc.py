"""WARC archives and a chunked record table.

``write`` makes WARC/1.1 files in a folder that all machines share, a file per task and one gzip member per record,
and returns their manifest. Payloads are cut into chunks before they reach a Python worker, which streams them into the archive, so no
worker holds a whole one. Of records with equal payloads (of at least a given size) that with the largest id is a
response and the others are revisits that refer to it. ``read`` turns archives into a table of chunks: a record of any size
becomes rows of its archive, its place there and chunk number, each with its bytes and the digest of the payload up to there, which is
carried on from chunk to chunk. ``records`` sums the chunks up, one row per record: sizes over all chunks, the digest of the last.

Files are written under a name of the task's attempt and then renamed; only those in the manifest are read, so lost or
repeated attempts leave no records behind.

Defined cases: a null payload is empty; empty payloads are equal to each other; any integer may be an id; rows without an id are archived
too, as responses, and come back without one; repeated rows are each archived, and those with the largest id of equal payloads
are responses; extra columns are ignored, whatever their names; an empty table gives no files and an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, broadcast_if_small, check_columns, emit, rows, scratch_path, staged

#: Bytes of a payload that go to a worker, into an archive and into a row of the chunk table at once.
CHUNK_BYTES = 1 << 14
_LINE = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _record_uri(record: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{record}')}>"


class Writer:
    """Writes records to an open stream, each as its own gzip member: ``begin``, any number of ``part``, ``end``."""

    def __init__(self, out, level: int = 1, date: str | None = None) -> None:
        self.out, self.level, self.records = out, level, 0
        self.date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.mark = uuid.uuid4().hex

    def begin(self, record: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> None:
        head = [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", _record_uri(f"{self.mark}:{self.records}" if record is None else record)),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        if record is not None:
            head.append(("X-Record-Number", str(record)))
        if refers_to is not None:
            head += [("WARC-Refers-To", _record_uri(refers_to)), ("X-Refers-To-Number", str(refers_to)), ("X-Payload-Length", str(size))]
            head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        length = len(_HTTP) + (size if refers_to is None else 0)
        lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head], f"Content-Length: {length}", "", ""]
        self.pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.out.write(self.pack.compress("\r\n".join(lines).encode() + _HTTP))
        self.records += 1

    def part(self, data: bytes) -> None:
        self.out.write(self.pack.compress(data))

    def end(self) -> None:
        self.out.write(self.pack.compress(_LINE + _LINE) + self.pack.flush())


class _Inflated(io.RawIOBase):
    """The bytes of a stream of gzip members, without ever holding more than a part of them."""

    def __init__(self, raw) -> None:
        self.raw, self.unpack, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if not self.rest:
                self.rest = self.raw.read(1 << 18)
                if not self.rest:
                    return 0
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            data = self.unpack.decompress(self.rest, len(buffer))
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if data:
                buffer[: len(data)] = data
                return len(data)


def parse(raw, chunk_bytes: int = CHUNK_BYTES, zipped: bool = True) -> Iterator[dict]:
    """The chunks of all records of an open archive, in order; a record with an empty payload has one empty chunk."""
    stream = io.BufferedReader(_Inflated(raw) if zipped else raw, 1 << 18)
    record = -1
    while True:
        line = stream.readline()
        if not line:
            return
        if line == _LINE:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (_LINE, b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left:
                line = stream.readline(left)
                left -= len(line)
                if line in (_LINE, b""):
                    break
        digest, offset, number, record = hashlib.sha1(), 0, 0, record + 1
        while True:
            data = stream.read(min(left, chunk_bytes))
            if left and not data:
                raise EOFError("an archive ends within a record")
            left -= len(data)
            digest.update(data)
            yield {
                "record": record,
                "record_id": int(head["x-record-number"]) if "x-record-number" in head else None,
                "chunk": number,
                "start": offset,
                "data": data,
                "digest": base64.b32encode(digest.copy().digest()).decode(),
                "last": not left,
                "kind": head.get("warc-type"),
                "url": head.get("warc-target-uri"),
                "stated_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                "stated_length": int(head["x-payload-length"]) if "x-payload-length" in head else None,
                "refers_to": int(head["x-refers-to-number"]) if "x-refers-to-number" in head else None,
            }
            offset, number = offset + len(data), number + 1
            if not left:
                break


_CHUNK = (
    "archive string, record long, record_id long, chunk int, start long, data binary, digest string, last boolean, kind string, url string, stated_digest string, stated_length long, refers_to long"
)
_CHUNK_ARROW = pa.schema(
    [("archive", pa.string()), ("record", pa.int64()), ("record_id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())]
    + [("kind", pa.string()), ("url", pa.string()), ("stated_digest", pa.string()), ("stated_length", pa.int64()), ("refers_to", pa.int64())]
)


def plan(pages: DataFrame, payload: str, page_id: str, smallest: int) -> DataFrame:
    """(__digest, __size, __first): for payloads that several rows have, the largest id among them."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keyed = pages.filter(F.col(page_id).isNotNull()).select(F.sha1(body).alias("__digest"), F.length(body).cast("long").alias("__size"), F.col(page_id).cast("long").alias("__id"))
    return keyed.filter(F.col("__size") >= smallest).groupBy("__digest", "__size").agg(F.max("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")


def write(pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", url: str = "url", smallest: int = 0) -> DataFrame:
    """Archive all rows of pages under folder (a URI all machines reach); the manifest: path and records of each file."""
    check_columns(pages, payload, page_id, url)
    bounded_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    given = pages.select(F.col(page_id).cast("long").alias("__id"), F.col(url).cast("string").alias("__url"), body.alias("__body"), F.sha1(body).alias("__key"), F.length(body).cast("long").alias("__len"))
    same = broadcast_if_small(staged(plan(pages, payload, page_id, smallest), "equal-payloads"))
    # beyond the broadcast's bound this is a shuffle, whose hot digests adaptive execution splits
    given = given.join(same, (F.col("__key") == F.col("__digest")) & (F.col("__len") == F.col("__size")), "left")
    refers = F.when(F.col("__id") != F.col("__first"), F.col("__first"))
    # a record's chunks follow each other; a revisit has one, without bytes
    chunks = F.when(refers.isNotNull(), 1).otherwise(F.greatest(F.ceil(F.col("__len") / CHUNK_BYTES), F.lit(1))).cast("int")
    given = given.select("__id", "__url", "__body", "__key", "__len", refers.alias("__refers"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__at"))
    piece = F.when(F.col("__refers").isNull(), F.substring("__body", F.col("__at") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))).otherwise(F.lit(b"").cast("binary"))
    given = given.select("__id", "__url", "__key", "__len", "__refers", "__at", piece.alias("__piece"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, writer = None, None
        for i, u, key, size, refers, at, piece in rows(batches, "__id", "__url", "__key", "__len", "__refers", "__at", "__piece"):
            if out is None:
                out = fs.open_output_stream(posixpath.join(base, name + ".open"))
                writer = Writer(out)
            if at == 0:
                if writer.records:
                    writer.end()
                writer.begin(i, u, size, base64.b32encode(bytes.fromhex(key)).decode(), refers)
            writer.part(piece)
        if out is not None:
            writer.end()
            out.close()
            fs.move(posixpath.join(base, name + ".open"), posixpath.join(base, name))
            yield emit({"path": [name], "records": [writer.records]}, schema)

    return staged(given.mapInArrow(run, "path string, records long"), "manifest")


def read(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the manifest's archives."""
    bounded_batches(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for (name,) in rows(batches, "path"):
            held: dict[str, list] = {n: [] for n in _CHUNK_ARROW.names}
            size = 0
            with fs.open_input_stream(posixpath.join(base, name), compression=None) as raw:
                for chunk in parse(raw, chunk_bytes):
                    size += len(chunk["data"])
                    held["archive"].append(name)
                    for n, v in chunk.items():
                        held[n].append(v)
                    if size >= 4_000_000 or len(held["chunk"]) >= 2000:
                        yield emit(held, _CHUNK_ARROW)
                        held, size = {n: [] for n in _CHUNK_ARROW.names}, 0
            if held["chunk"]:
                yield emit(held, _CHUNK_ARROW)

    files = manifest.count()
    return manifest.repartition(max(1, files), "path").mapInArrow(run, _CHUNK) if files else manifest.sparkSession.createDataFrame([], _CHUNK)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: its kind, length and digest as read, and as stated where it is a revisit; the number of its chunks.

    A record is intact if its chunks are all there, one after another, and their digest is the stated one.
    """
    last = lambda c: F.max(F.when(F.col("last"), F.col(c))).alias(c)
    size = F.length("data").cast("long")
    found = chunks.groupBy("archive", "record").agg(
        F.sum(size).alias("size"), F.count("*").alias("chunks"), F.max("chunk").alias("final"), F.max(F.when(F.col("last"), F.col("start") + size)).alias("end"), *map(last, ("record_id", "digest", "kind", "url", "stated_digest", "stated_length", "refers_to"))
    )
    revisit = F.col("kind") == "revisit"
    whole = (F.col("size") == F.col("end")) & (F.col("chunks") == F.col("final") + 1)
    return found.select(
        "record_id",
        "url",
        F.when(revisit, F.col("stated_length")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
        F.coalesce(revisit | (whole & (F.col("digest") == F.col("stated_digest"))), F.lit(False)).alias("intact"),
        "chunks",
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder, read the archives back into a chunk table, written there too, and sum its records up."""
    folder = scratch_path(spark, "warc")
    manifest = write(pages, folder)
    return records(staged(read(manifest, folder), "record-chunks"))
