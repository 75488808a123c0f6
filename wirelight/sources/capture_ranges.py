"""Capture files of any size, each read by as many tasks as it has splits.

A classic capture is a chain: a frame's header says where the next one begins. A
task that starts in mid-file looks for a place from which several plausible frame
headers follow one another, and reads on from there. What lies before that place,
and the frame its split breaks off in, are handed on as bytes; put together in
file order they must give whole frames and end exactly where the next task began.
Where they don't, or where a file isn't a classic capture (pcapng), the file's
bytes, which the table holds all of, are read in order by one task.

Spark's text source cuts the files and opens them: a "line" is the bytes up to the
next byte 10, whatever they mean.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelight.operators.lookup import fits_broadcast, materialise
from wirelight.sources.pcap import _CUT, _MAGIC, BrokenCapture, block_reader, frame_rows

WINDOW = 1 << 20  # bytes in which a split's first frame header is looked for
MOST = 1 << 18  # bytes of a frame
CHAIN = 5  # headers that must follow one another
OVER_END = 3  # headers that suffice if the chain leaves the split
YEAR = 366 * 86_400
PIECE = 1 << 20
MOST_AT_ONCE = 1 << 26  # bytes of whole frames that become one batch

HEAD, FRAME, TAIL, SPLIT = 0, 1, 2, 3
# A frame's bytes are its ``body``, those of a head or tail its ``rest``: what reads the few ends doesn't read all frames.
# A split's last row counts its rows: heads as ``original``, frames as ``fraction``, with the first one's seq as ``seconds``;
# its order is NULL where nothing but heads was found.
_TABLE = "source_file string, block bigint, seq bigint, kind int, order string, seconds bigint, fraction bigint, original bigint, captured int, body binary, rest binary"
_NAMES = [c.split(" ")[0] for c in _TABLE.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_FOUND = "source_file string, block bigint, seq bigint, seconds bigint, fraction bigint, linktype int, body binary, error string"


def _plausible(data: bytes | bytearray, at: int, order: str) -> tuple[int, int] | None:
    """(seconds, size) of a frame header that may be one."""
    seconds, fraction, size, original = struct.unpack_from(order + "4I", data, at)
    return (seconds, size) if 0 < size <= MOST and size <= original < 1 << 24 and fraction < 1_000_000_000 else None


def _holds(data: bytes | bytearray, at: int, order: str, ends_here: bool) -> bool:
    """Whether a chain of frame headers starts here."""
    before, seen = None, 0
    while seen < CHAIN:
        if at + 16 > len(data):
            return seen >= OVER_END and (ends_here or at + 16 > len(data))
        found = _plausible(data, at, order)
        if found is None or (before is not None and abs(found[0] - before) > YEAR):
            return False
        before, at, seen = found[0], at + 16 + found[1], seen + 1
    return True


def resync(data: bytes | bytearray, ends_here: bool = True) -> tuple[int, str] | None:
    """First place from which frame headers follow one another, and their byte order."""
    n = len(data) - 15
    if n <= 0:
        return None
    raw = np.frombuffer(bytes(data), dtype=np.uint8).astype(np.uint32)
    found = []
    for order in "<>":
        shifts = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)

        def number(off: int, shifts=shifts) -> np.ndarray:
            return sum(raw[off + i : off + i + n] << np.uint32(s) for i, s in enumerate(shifts))

        fraction, size, original = number(4), number(8), number(12)
        for at in np.flatnonzero((size > 0) & (size <= MOST) & (size <= original) & (original < 1 << 24) & (fraction < 1_000_000_000)).tolist():
            if found and at >= found[0][0]:
                break
            if _holds(data, at, order, ends_here):
                found = [(at, order)]
                break
    return found[0] if found else None


def _chain(data: bytearray, order: str) -> tuple[list[int], int]:
    """Where whole frames begin, one behind the other, and where the last one ends."""
    size = struct.Struct(order + "I").unpack_from
    starts, at, last = [], 0, len(data) - 16
    while at <= last and at < MOST_AT_ONCE:
        after = at + 16 + size(data, at + 8)[0]
        if after > len(data):
            break
        starts.append(at)
        at = after
    return starts, at


class _Split:
    """Takes one split's bytes in order; gives its rows as Arrow batches."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.first = file, block, block == 0
        self.order, self.buffer, self.seq, self.fed = None, bytearray(), 0, False
        self.raw, self.made = False, Counter()

    def _batch(self, kind: int, columns: list[pa.Array | None], n: int) -> pa.RecordBatch:
        """``n`` rows of a kind; ``columns`` are those behind the order, None for NULLs."""
        seq = pa.array(np.arange(self.seq, self.seq + n))
        self.seq += n
        self.made[kind] += n
        known = [pa.repeat(pa.scalar(v, k), n) for v, k in ((self.file, pa.string()), (self.block, pa.int64()))]
        told = [pa.repeat(pa.scalar(v, k), n) for v, k in ((kind, pa.int32()), (self.order, pa.string()))]
        rest = [pa.nulls(n, k) if c is None else c for c, k in zip(columns, _KINDS[5:], strict=True)]
        return pa.RecordBatch.from_arrays([*known, seq, *told, *rest], names=_NAMES)

    def _end(self, kind: int, data: bytearray) -> pa.RecordBatch:
        return self._batch(kind, [None] * 5 + [pa.array([bytes(data)], pa.binary())], 1)

    def _frames(self, starts: list[int], end: int) -> pa.RecordBatch:
        raw = np.frombuffer(bytes(self.buffer[:end]), dtype=np.uint8)
        at = np.array(starts, dtype=np.int64)[:, None] + np.arange(16)
        seconds, fraction, size, original = raw[at].view(self.order + "u4").astype(np.int64).T
        inside = np.ones(end, dtype=bool)
        inside[at] = False
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        body = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        return self._batch(FRAME, [pa.array(seconds), pa.array(fraction), pa.array(original), pa.array(size.astype(np.int32)), body, None], len(starts))

    def feed(self, data: bytes) -> Iterator[pa.RecordBatch]:
        self.buffer += data
        if len(self.buffer) >= PIECE:
            yield from self._read(False)

    def lines(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        """The next lines; a byte 10 is between two of them."""
        if self.fed:
            self.buffer += b"\n"
        self.fed = True
        yield from self.feed(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"\n")[0].as_py())

    def end(self, last: bool) -> Iterator[pa.RecordBatch]:
        # the byte 10 behind the last line of a file may not be there
        if not last:
            self.buffer += b"\n"
        yield from self._read(True)
        if self.buffer:
            yield self._end(TAIL if self.order else HEAD, self.buffer)
        yield self._count()

    def _count(self) -> pa.RecordBatch:
        heads, frames = self.made[HEAD], self.made[FRAME]
        if not frames + self.made[TAIL]:
            self.order = None
        # heads come before the frames
        numbers = [pa.array([n], pa.int64()) for n in (heads, frames, heads)]
        return self._batch(SPLIT, [*numbers, None, None, pa.array([b""], pa.binary())], 1)

    def _read(self, ended: bool) -> Iterator[pa.RecordBatch]:
        if self.order is None and not self.raw:
            if self.first:
                known = _MAGIC.get(bytes(self.buffer[:4]))
                self.raw = known is None or len(self.buffer) < 24
                start, self_order = 24, known and known[0]
            else:
                place = resync(self.buffer[:WINDOW], ended and len(self.buffer) <= WINDOW)
                self.raw = place is None
                start, self_order = place or (0, None)
            if not self.raw:
                if start:
                    yield self._end(HEAD, self.buffer[:start])
                del self.buffer[:start]
                self.order = self_order
        if self.raw:
            # nothing is known of these bytes: all are handed on
            for lo in range(0, len(self.buffer), PIECE):
                yield self._end(HEAD, self.buffer[lo : lo + PIECE])
            self.buffer.clear()
            return
        while (found := _chain(self.buffer, self.order))[0]:
            yield self._frames(*found)
            del self.buffer[: found[1]]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of one file and block, as (from, to)."""
    n = batch.num_rows
    new = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
    yield from pairwise([0, *(np.flatnonzero(new[0] | new[1]) + 1).tolist(), n])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source_file, block, last, value) as the text source gives them."""
    split, last = None, False
    made: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        nonlocal made
        if made:
            yield pa.concat_batches(made)
        made = []

    for batch in batches:
        if not batch.num_rows:
            continue
        for lo, hi in _runs(batch):
            file, block = batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py()
            if split is None or (file, block) != (split.file, split.block):
                if split is not None:
                    made += split.end(last)
                split, last = _Split(file, block), batch.column(2)[lo].as_py()
            made += split.lines(batch.column(3).slice(lo, hi - lo))
            if sum(m.num_rows for m in made) >= 10_000 or sum(m.nbytes for m in made) >= 4 * PIECE:
                yield from whole()
    if split is not None:
        made += split.end(last)
    yield from whole()


def _found(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads and tails by file, block, seq -> the frames that lie across splits, and what is wrong with a file.

    A file that must be read in order gives a row with the error ``order``.
    """
    file, block, order, pending, bad, link, seq = None, 0, None, bytearray(), False, None, 0

    def whole(out: list) -> None:
        nonlocal seq
        at = 0
        while at + 16 <= len(pending):
            seconds, fraction, size, _ = struct.unpack_from(order + "4I", pending, at)
            if at + 16 + size > len(pending):
                break
            out.append((file, block, seq, seconds, fraction, link, bytes(pending[at + 16 : at + 16 + size]), None))
            seq += 1
            at += 16 + size
        del pending[:at]

    def ended(out: list) -> None:
        if file is None or bad:
            return
        if pending:
            pending.extend(b"\n")
            whole(out)
        if pending:
            out.append((file, block, seq, None, None, None, None, f"pcap: frame {_CUT}"))

    for batch in batches:
        out: list[tuple] = []
        for f, b, s, kind, o, body, synced in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if f != file:
                ended(out)
                file, block, order, pending, bad, link, seq = f, 0, None, bytearray(), False, None, 1 << 40
                known = _MAGIC.get(body[:4]) if b == 0 and len(body) >= 24 and synced else None
                if known is None:
                    bad = True
                    out.append((file, 0, 0, None, None, None, None, "order"))
                else:
                    order = known[0]
                    link = struct.unpack_from(order + "I", body, 20)[0] & 0x0FFFFFFF
                    out.append((file, -1, 0, 0 if order == "<" else 1, known[1], link, None, None))
                    continue
            if bad:
                continue
            if kind == TAIL:
                block, seq = b, 1 << 40
            pending += body
            whole(out)
            # a split whose frames were read must begin where this chain ends
            if kind == HEAD and synced and (pending or o != order) or len(pending) > 16 + MOST + (1 << 24):
                bad = True
                out.append((file, 0, 0, None, None, None, None, "order"))
            elif kind == HEAD and synced:
                block, seq = b, 1 << 40
        if out:
            yield _found(out)
    out = []
    ended(out)
    if out:
        yield _found(out)


def _classic_reader() -> Callable[[bytearray, bool], Iterator[tuple]]:
    """Takes the bytes so far and whether they are all; gives frames and drops their bytes."""
    state: dict = {}

    def read(buffer: bytearray, ended: bool) -> Iterator[tuple]:
        if not state:
            if len(buffer) < 24:
                if ended:
                    raise BrokenCapture(f"pcap: file header {_CUT}")
                return
            state["order"], state["units"] = _MAGIC[bytes(buffer[:4])]
            state["link"] = struct.unpack_from(state["order"] + "I", buffer, 20)[0] & 0x0FFFFFFF
            del buffer[:24]
        at = 0
        while at + 16 <= len(buffer):
            seconds, fraction, size, _ = struct.unpack_from(state["order"] + "4I", buffer, at)
            if at + 16 + size > len(buffer):
                break
            yield seconds * 1_000_000 + fraction // state["units"], state["link"], bytes(buffer[at + 16 : at + 16 + size])
            at += 16 + size
        del buffer[:at]
        if ended and buffer:
            raise BrokenCapture(f"pcap: frame {_CUT}")

    return read


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a file in order -> its frames, read as one stream of bytes; times in microseconds."""
    file, buffer, reader, number, broken = None, bytearray(), None, 0, False

    def step(out: list, ended: bool) -> None:
        nonlocal reader, number, broken
        if broken or (reader is None and len(buffer) < 4 and not ended):
            return
        try:
            if reader is None:
                if bytes(buffer[:4]) == b"\n\r\r\n":
                    reader = block_reader()
                elif bytes(buffer[:4]) in _MAGIC:
                    reader = _classic_reader()
                else:
                    raise BrokenCapture("pcap: not a capture file")
            for micros, link, body in reader(buffer, ended):
                out.append((file, 0, number, micros, None, link, body, None))
                number += 1
        except BrokenCapture as problem:
            broken = True
            out.append((file, 0, number, None, None, None, None, str(problem)))
        if broken:
            buffer.clear()

    def finish(out: list) -> None:
        if file is None or broken:
            return
        step(out, False)
        if buffer or reader is None:
            buffer.extend(b"\n")  # the last byte 10 of a file is not in its last line
            step(out, False)
            if bytes(buffer) == b"\n":
                buffer.clear()
            if buffer or reader is None:
                step(out, True)

    for batch in batches:
        out: list[tuple] = []
        for f, order, kind, seconds, fraction, original, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if f != file:
                finish(out)
                file, buffer, reader, number, broken = f, bytearray(), None, 0, False
            if broken:
                continue
            buffer += struct.pack(order + "4I", seconds, fraction, len(body), original) + body if kind == FRAME else body
            if len(buffer) >= PIECE:
                step(out, False)
            if len(out) >= 10_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)
    out = []
    finish(out)
    if out:
        yield _found(out)


def capture_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frames and errors of all capture files under a path: source_file, frame_no, micros, linktype, captured, payload, _error."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("last"),
        F.col("value").cast("binary").alias("value"))
    table = materialise(lines.mapInArrow(_splits, _TABLE), "captures")
    kind = F.col("kind")
    few = materialise(table.where("rest IS NOT NULL").drop("captured", "body"), "ends")
    splits = few.where(kind == SPLIT).select("source_file", "block", F.col("order").isNotNull().alias("synced"), F.col("order").alias("_order"),
                                             (F.col("original") > 0).alias("_headed"), F.col("seconds").alias("_first"), F.col("fraction").alias("_n"))
    ends = few.where(kind != SPLIT).drop("order").join(splits, ["source_file", "block"]).select(
        "source_file", "block", "seq", "kind", F.col("_order").alias("order"), F.col("rest").alias("body"),
        (F.col("synced") | ((F.col("block") == 0) & (F.length("rest") == 24))).alias("synced"))
    # a synchronised split without a head begins with a frame: an empty head stands for it
    bare = splits.where("synced AND NOT _headed").select(
        "source_file", "block", F.lit(-1).cast("bigint").alias("seq"), F.lit(HEAD).alias("kind"), F.col("_order").alias("order"), F.lit(b"").alias("body"), "synced")
    heads = ends.unionByName(bare)
    # the frames of one split end are all one task needs of it: bytes of about a frame
    joints = materialise(heads.repartition("source_file").sortWithinPartitions("source_file", "block", "seq").mapInArrow(_joints, _FOUND), "joints")
    slow = joints.where("error = 'order'").select("source_file").distinct()
    facts = joints.where("block = -1").select("source_file", F.col("fraction").alias("units"), "linktype")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if fits_broadcast(df) else df

    slow_side, facts = small(slow), small(facts)
    across = joints.where("block >= 0 AND (error IS NULL OR error <> 'order')")
    # a split's frames are numbered without gaps, its last ones from 2**40 on
    inner = splits.where("_n > 0").select("source_file", "block", F.lit(False).alias("_end"), "_first", "_n")
    outer = across.groupBy("source_file", "block").agg(F.lit(True).alias("_end"), F.min("seq").alias("_first"), F.count("*").alias("_n"))
    counts = inner.unionByName(outer).join(slow_side, "source_file", "left_anti").join(facts, "source_file")
    before = Window.partitionBy("source_file").orderBy("block", "_end").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source_file", "block", "_end", "units", "linktype", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    quick = table.where(kind == FRAME).select("source_file", "block", F.lit(False).alias("_end"), "seq", "seconds", "fraction", "captured", "body", F.lit(None).cast("string").alias("error"))
    quick = quick.unionByName(across.select("source_file", "block", F.lit(True).alias("_end"), "seq", "seconds", "fraction", F.length("body").alias("captured"), "body", "error"))
    numbered = quick.join(small(materialise(offsets, "offsets")), ["source_file", "block", "_end"])
    micros = F.col("seconds") * 1_000_000 + F.floor(F.col("fraction") / F.col("units")).cast("bigint")
    by_split = numbered.select("source_file", (F.col("seq") + F.col("_offset")).alias("frame_no"), micros.alias("micros"),
                               F.when(F.col("error").isNull(), F.col("linktype")).alias("linktype"), "captured", "body", "error")
    all_of = table.where(kind != SPLIT).join(slow_side, "source_file", "left_semi").repartition("source_file").sortWithinPartitions("source_file", "block", "seq")
    one_by_one = all_of.select(
        "source_file", "order", "kind", "seconds", "fraction", "original", F.coalesce("rest", "body").alias("body")).mapInArrow(_in_order, _FOUND)
    in_order = one_by_one.select("source_file", F.col("seq").alias("frame_no"), F.col("seconds").alias("micros"), "linktype", F.length("body").alias("captured"), "body", "error")
    return by_split.unionByName(in_order).select(
        "source_file", "frame_no", "micros", "linktype", "captured", F.col("body").alias("payload"), F.col("error").alias("_error"))


def pcap_frames(spark: SparkSession, path: str | list[str], on_error: str = "fail") -> DataFrame:
    """Frames of all capture files under a path; ``on_error`` is as for ``split_captures``."""
    return frame_rows(capture_rows(spark, path), on_error)
