"""WARC archives of individually compressed records with a shared dictionary.

A Zstandard dictionary is trained on a bounded sample of the records. Each
archive starts with a skippable frame that holds it; then every record is one
frame of its own, so a reader can start at any record. Tasks write archives into
a folder under names of their own attempt, and a stored manifest names those of
the attempts that counted, so lost executors leave at most unread files.

Equal payloads are archived once, under the smallest page id; the others are
revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelight.llm.workspace import Workspace, look_up, make_folder

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE = 1000
BROADCAST_COPIES = 500_000
END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the response's headers and no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP if refers_to is not None else HTTP + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Bytes: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + END + block + END + END


def parse(data: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = data.partition(END + END)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields | {"payload": block.partition(END + END)[2]}


def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def _filesystem(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root)


def _write(root: str, dictionary, date: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, folder = _filesystem(root)
        shared = _dictionary(dictionary.value)
        packer = zstandard.ZstdCompressor(level=6, dict_data=shared) if shared else zstandard.ZstdCompressor(level=6)
        stream, done, count, used = None, [], 0, 0
        name = ""
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if stream is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    stream, count = files.open_output_stream(f"{folder}/{name}", compression=None), 0
                    frame = struct.pack("<II", SKIPPABLE, len(dictionary.value)) + dictionary.value
                    stream.write(frame)
                    used = len(frame)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                frame = packer.compress(record(page_id, url, payload, digest, refers_to, date))
                stream.write(frame)
                used, count = used + len(frame), count + 1
                if used >= most:
                    stream.close()
                    done.append((name, count, used))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, count, used))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["archive", "records", "bytes"])

    return run


def frames(stream, room: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, in order, a piece of the file at a time."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, length = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary's frame")
    shared = _dictionary(stream.read(length))
    unpacker = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    rest = stream.read(room)
    while rest:
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not rest:
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(room)
        yield b"".join(parts)
        rest = rest or stream.read(room)


def _read(root: str, rows: int = 256):
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for data in frames(stream):
                        x = parse(data)
                        kind = x["WARC-Type"]
                        held.append((number(x["WARC-Record-ID"]), x["WARC-Target-URI"], x["payload"] if kind == "response" else None, int(x["WARC-Payload-Bytes"]), x["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(x.get("WARC-Refers-To"))))
                        size += len(data)
                        if len(held) >= rows or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return run


def write_archives(pages: DataFrame, root: str, space: Workspace, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, sample: int = SAMPLE) -> DataFrame:
    """Writes the pages (page_id, url, html) under `root`; the stored manifest (archive, records, bytes).

    A NULL html is an empty payload, a NULL url an empty one. Payloads of at least
    `least_bytes` are deduplicated: rows with the smallest id of a payload are
    responses, all others revisits (also a row with a NULL id, if another has one).
    Repeated rows are archived each. Other columns are not read; an empty table
    writes nothing.
    """
    make_folder(pages.sparkSession, root)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digests = pages.where(F.length(payload) >= least_bytes).select("page_id", F.sha2(payload, 256).alias("digest"))
    copies = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    copies = space.keep(copies, "copies")
    marked = pages.withColumn("digest", F.when(F.length(payload) >= least_bytes, F.sha2(payload, 256)))
    if copies.count() <= BROADCAST_COPIES:
        marked = marked.join(F.broadcast(copies.drop("members")), "digest", "left")
    else:
        marked = look_up(marked, copies, "digest", "members")
    rows = marked.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to"))
    ids = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select(F.col("page_id").alias("_id"))
    some = pages.join(F.broadcast(ids), F.col("page_id") == F.col("_id"), "left_semi").limit(sample)
    few = some.select("page_id", "url", F.substring("html", 1, 20_000).alias("html")).collect()
    samples = [record(r.page_id, r.url, (r.html or "").encode("utf-8", "surrogatepass"), "A" * 32, None, date) for r in few]
    dictionary = pages.sparkSession.sparkContext.broadcast(make_dictionary(samples))
    return space.keep(rows.mapInArrow(_write(root, dictionary, date, archive_bytes), "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """One row per record of the manifest's archives, in no order; `payload` is NULL for revisits."""
    spread = manifest.select("archive").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.xxhash64("archive"))
    return spread.mapInArrow(_read(root), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
