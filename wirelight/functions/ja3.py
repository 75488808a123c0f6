"""JA3 fingerprints of TLS client hellos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.functions.columns import derive_once
from wirelight.sources.pcap import transport

# Values clients send to keep servers tolerant; two equal bytes ending in A.
GREASE = [n << 12 | 0xA00 | n << 4 | 0xA for n in range(16)]

_LISTS = ["ciphers", "extensions", "curves", "formats"]
_HELLO = T.StructType(
    [T.StructField("version", T.IntegerType())]
    + [T.StructField(name, T.ArrayType(T.IntegerType())) for name in _LISTS]
)


def _lists(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int, known: np.ndarray) -> pa.Array:
    """Lists of big-endian numbers: ``counts`` numbers of ``width`` bytes from ``starts`` on; NULL where not known."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    at = np.repeat(starts - width * offsets[:-1].astype(np.int64), counts) + width * np.arange(offsets[-1], dtype=np.int64)
    numbers = data[at].astype(np.int32)
    for i in range(1, width):
        numbers = numbers << 8 | data[at + i]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers), mask=pa.array(~known))


def _bytes_of(payloads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and ends; NULL is empty."""
    payloads = payloads.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
    held = payloads.buffers()[2]
    # a few bytes behind the end, for places of values that are too short
    return np.concatenate([np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8), np.zeros(8, np.uint8)]), offsets[:-1].copy(), offsets[1:].copy()


def _hellos(payloads: pa.Array) -> pa.StructArray:
    """All payloads are read side by side, field by field; one that is too short for a field has no hello."""
    data, at, stop = _bytes_of(payloads)
    good = np.ones(len(at), bool)
    top = len(data) - 8

    def number(size: int) -> np.ndarray:
        """The next number of each payload; 0 where there is none any more."""
        nonlocal at, good
        good &= at + size <= stop
        place, found = np.minimum(at, top), np.zeros(len(at), np.int64)
        for i in range(size):
            found = found << 8 | data[place + i]
        at = at + size
        return np.where(good, found, 0)

    def skip(size: np.ndarray | int) -> np.ndarray:
        """Passes over bytes; where they began."""
        nonlocal at, good
        before = at
        good &= at + size <= stop
        at = at + size
        return before

    kind, version, size = number(1), number(2), number(2)
    good &= (kind == 22) & (version >= 0x0300) & (version <= 0x0304) & (size > 0) & (at + size <= stop)
    stop = np.where(good, at + size, stop)
    good &= number(1) == 1
    skip(3)
    version = number(2)
    skip(32)
    skip(number(1))
    n_ciphers = number(2) // 2
    ciphers = skip(2 * n_ciphers)
    skip(number(1))
    # extensions: (payload, step, kind), and the last lists of curves and formats
    open_ = good & (stop - at >= 2)
    listed = np.where(open_, data[np.minimum(at, top)].astype(np.int64) << 8 | data[np.minimum(at + 1, top)], 0)
    at = at + 2
    end = np.where(open_, np.minimum(at + listed, stop), at)
    which, kinds = [], []
    lists = {10: (2, 2, at.copy(), np.zeros(len(at), np.int64)), 11: (1, 1, at.copy(), np.zeros(len(at), np.int64))}
    rows = np.flatnonzero(open_ & (at < end))
    place = at
    while len(rows):
        here, last = place[rows], end[rows]
        whole = here + 4 <= last
        here = np.minimum(here, top - 4) if top >= 4 else here * 0
        kind = data[here].astype(np.int64) << 8 | data[here + 1]
        body = here + 4
        after = body + (data[here + 2].astype(np.int64) << 8 | data[here + 3])
        whole &= after <= last
        for code, (head, width, starts, counts) in lists.items():
            mine = whole & (kind == code)
            if mine.any():
                b, a, r = body[mine], after[mine], rows[mine]
                fits = b + head <= a
                b = np.where(fits, b, 0)
                size = data[b].astype(np.int64) if head == 1 else data[b].astype(np.int64) << 8 | data[b + 1]
                fits &= (b + head + size <= a) & (size % width == 0)
                whole[np.flatnonzero(mine)[~fits]] = False
                starts[r[fits]], counts[r[fits]] = (b + head)[fits], (size // width)[fits]
        good[rows[~whole]] = False
        rows, kind, after = rows[whole], kind[whole], after[whole]
        which.append(rows)
        kinds.append(kind)
        place[rows] = after
        rows = rows[after < end[rows]]
    which, kinds = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, kinds))
    order = np.argsort(which, kind="stable")
    which, kinds = which[order], kinds[order]
    kinds = kinds[good[which]]
    n_kinds = np.bincount(which[good[which]], minlength=len(good))
    offsets = np.zeros(len(good) + 1, np.int32)
    np.cumsum(n_kinds, out=offsets[1:])
    extensions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kinds.astype(np.int32)), mask=pa.array(~good))

    def some(starts: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
        return _lists(data, np.where(good, starts, 0), np.where(good, counts, 0), width, good)

    return pa.StructArray.from_arrays([
        pa.array(version.astype(np.int32), mask=~good), some(ciphers, n_ciphers, 2), extensions,
        *[some(starts, counts, width) for _, width, starts, counts in lists.values()],
    ], names=["version", *_LISTS])


@F.arrow_udf(_HELLO)
def client_hello(payloads: pa.Array) -> pa.Array:
    """Fields of the client hello a TCP payload starts with, NULLs when there is none."""
    return _hellos(payloads)


def ja3_text(hello: Column) -> Column:
    """``version,ciphers,extensions,curves,formats`` without GREASE values."""
    def joined(name: str) -> Column:
        kept = F.filter(hello[name], lambda n: ~n.isin(GREASE))
        return F.array_join(kept.cast("array<string>"), "-")

    parts = [hello["version"].cast("string")] + [joined(n) for n in _LISTS]
    return F.when(hello["version"].isNotNull(), F.concat(*[x for p in parts for x in (p, F.lit(","))][:-1]))


def frames_ja3(frames: DataFrame) -> DataFrame:
    """Client hellos among the frames, with JA3 text and its MD5 digest."""
    tcp = transport(frames).where(F.col("proto") == "tcp")
    payload = F.substring(F.col("payload"), F.col("body") + 1, F.length("payload"))
    # only handshake records reach Python
    hellos = tcp.withColumn("_tls", payload).where(F.hex(F.substring("_tls", 1, 1)) == "16")
    hellos = hellos.withColumn("_hello", client_hello("_tls")).where("_hello.version IS NOT NULL")
    # the text is worked out once for itself and its digest
    return derive_once(hellos, {"ja3_text": ja3_text(F.col("_hello"))}).select(
        "ts", "srcIP", "srcPort", "destIP", "destPort", "ja3_text", F.md5("ja3_text").alias("ja3"), "source_file"
    )
