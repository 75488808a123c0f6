"""Packet captures: frames, and the connections and DNS queries in them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight import schemas
from wirelight.functions.columns import derive_once
from wirelight.functions.ip import key_text, unmapped_key
from wirelight.functions.values import dns_type_name
from wirelight.sources.lines import ERROR, route

ETHERNET = 1
_BATCH = 8192
_QUESTION = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("type", T.IntegerType()),
])

# Capture file magic numbers -> (byte order, fraction units per microsecond).
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}


# Header of a classic file: little-endian, microseconds, Ethernet.
_CLASSIC_HEAD = bytes.fromhex("d4c3b2a1" + "02000400" + "00000000" * 2 + "ffff0000" + "01000000")

# Block types of the next-generation capture format.
_SECTION, _INTERFACE, _OLD_PACKET, _SIMPLE, _PACKET = 0x0A0D0D0A, 1, 2, 3, 6


_CUT = "cut off"


class BrokenCapture(ValueError):
    """What is wrong with a capture file, from some place on."""


def _classic_frames(content: bytes) -> Iterator[tuple]:
    """(micros, linktype, bytes) of a classic capture file."""
    order, units = _MAGIC[content[:4]]
    if len(content) < 24:
        raise BrokenCapture(f"pcap: file header {_CUT}")
    linktype = struct.unpack_from(order + "I", content, 20)[0] & 0x0FFFFFFF
    at = 24
    while at < len(content):
        if at + 16 > len(content):
            raise BrokenCapture(f"pcap: frame header {_CUT} at {at}")
        seconds, fraction, size, _ = struct.unpack_from(order + "IIII", content, at)
        at += 16
        if at + size > len(content):
            raise BrokenCapture(f"pcap: frame {_CUT} at {at}")
        yield seconds * 1_000_000 + fraction // units, linktype, content[at : at + size]
        at += size


def _ticks_per_second(order: str, options: bytes) -> int:
    """Resolution of an interface's times; a million where it doesn't say."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size == 1 and at + 5 <= len(options):
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + size + -size % 4
    return 1_000_000


def block_reader() -> Callable[[bytearray, bool], Iterator[tuple]]:
    """Reads a capture file made of blocks (pcapng) as its bytes come.

    Given the bytes so far and whether they are all, it gives (micros, linktype,
    bytes) of the frames in whole blocks and drops those blocks' bytes. A frame
    without a time has NULL.
    """
    order, interfaces, passed = "<", [], 0

    def read(buffer: bytearray, ended: bool) -> Iterator[tuple]:
        nonlocal order, interfaces, passed
        at = 0
        while at + 12 <= len(buffer):
            if buffer[at : at + 4] == b"\n\r\r\n":
                order, interfaces = "<" if buffer[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
            kind, size = struct.unpack_from(order + "II", buffer, at)
            if size < 12 or size % 4:
                raise BrokenCapture(f"pcapng: block {_CUT} at {passed + at}")
            if at + size > len(buffer):
                break
            body = bytes(buffer[at + 8 : at + size - 4])
            try:
                if kind == _INTERFACE:
                    link, _, snap = struct.unpack_from(order + "HHI", body)
                    interfaces.append((link, snap, _ticks_per_second(order, body[8:])))
                elif kind == _PACKET:
                    port, high, low, kept, _ = struct.unpack_from(order + "5I", body)
                    link, _, ticks = interfaces[port]
                    yield (high << 32 | low) * 1_000_000 // ticks, link, body[20 : 20 + kept]
                elif kind == _OLD_PACKET:
                    port, _, high, low, kept, _ = struct.unpack_from(order + "HH4I", body)
                    link, _, ticks = interfaces[port]
                    yield (high << 32 | low) * 1_000_000 // ticks, link, body[20 : 20 + kept]
                elif kind == _SIMPLE:
                    (length,) = struct.unpack_from(order + "I", body)
                    link, snap, _ = interfaces[0]
                    yield None, link, body[4 : 4 + (min(length, snap) if snap else length)]
            except (IndexError, struct.error):
                raise BrokenCapture(f"pcapng: block without its interface or cut short at {passed + at}") from None
            at += size
        del buffer[:at]
        passed += at
        if ended and buffer:
            raise BrokenCapture(f"pcapng: block {_CUT} at {passed}")

    return read


def _block_frames(content: bytes) -> Iterator[tuple]:
    return block_reader()(bytearray(content), True)


def _split_frames(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of a capture file; what can't be read is one row with an error."""
    number = 0
    try:
        if content[:4] == b"\n\r\r\n":
            found = _block_frames(content)
        elif content[:4] in _MAGIC:
            found = _classic_frames(content)
        else:
            raise BrokenCapture("pcap: not a capture file")
        for micros, linktype, data in found:
            yield path, number, micros, linktype, len(data), data, None
            number += 1
    except BrokenCapture as problem:
        yield path, number, None, None, None, None, str(problem)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = ["source_file", "frame_no", "micros", "linktype", "captured", "payload", ERROR]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for row in _split_frames(path.as_py(), content.as_py() or b""):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def split_captures(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Frames of capture files (columns path, content), each file cut in its own task.

    Classic files and files made of blocks (pcapng).  A file that is no capture,
    or breaks off inside a frame, is one malformed row after its good frames:
    ``fail`` stops the job, ``skip`` leaves it out, ``keep`` adds it with its
    message in ``_error`` (see ``lines.split_errors``).  A file that breaks off,
    as one that is still being written does, isn't a reason for ``fail`` to stop.
    """
    raw = files.select("path", "content").mapInArrow(
        _frames,
        f"source_file string, frame_no bigint, micros bigint, linktype int, captured int, payload binary, {ERROR} string",
    )
    return frame_rows(raw, on_error)


def joined_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (path, bytes), a path's one after another -> a classic capture file (path, content) per path.

    Bytes that are NULL are no frame.
    """
    path, parts = None, None
    for batch in batches:
        done: list[tuple] = []
        paths, records = batch.columns
        starts = [0, *(np.flatnonzero(np.diff(paths.dictionary_encode("encode").indices.to_numpy())) + 1).tolist()] if batch.num_rows else []
        pieces = pa.ListArray.from_arrays(pa.array([*starts, batch.num_rows], pa.int32()), records.fill_null(b""))
        for name, piece in zip(paths.take(pa.array(starts, pa.int64())).to_pylist(), pc.binary_join(pieces, b"").to_pylist(), strict=True):
            if parts is None or name != path:
                if parts is not None:
                    done.append((path, b"".join(parts)))
                path, parts = name, [_CLASSIC_HEAD]
            parts.append(piece)
        if done:
            yield _contents(done)
    if parts is not None:
        yield _contents([(path, b"".join(parts))])


def _contents(files: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])


def frame_rows(raw: DataFrame, on_error: str) -> DataFrame:
    """Frames with their times, and malformed rows as ``split_captures`` says."""
    rows = raw.select(*[
        (F.timestamp_micros("micros") if f.name == "ts" else F.col(f.name)).alias(f.name)
        for f in schemas.FRAME.fields
    ], ERROR)
    if on_error == "fail":
        rows = rows.where(~F.coalesce(F.contains(F.col(ERROR), F.lit(_CUT)), F.lit(False)))
    return route(rows, on_error)


def _number(hexed: Column, at: Column | int, size: int) -> Column:
    """Unsigned number from ``size`` bytes at a byte offset of hex text."""
    start = at * 2 + 1 if isinstance(at, int) else at * 2 + F.lit(1)
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.substring(hexed, start, F.lit(size * 2)), 16, 10).cast("int")


def _past_extensions(h: Column, at: Column, following: Column, size: Column) -> Column:
    """(at, next): place and kind of the first header behind an IPv6 header that is no extension.

    Each extension takes eight bytes at least, so the steps are bounded by the
    frame's own length.
    """
    counted = (0, 43, 60, 135, 139, 140)
    start = F.struct(at.alias("at"), following.alias("next"))

    def step(s: Column, _: Column) -> Column:
        at, kind = s["at"], s["next"]
        length = F.when(kind == 51, (_number(h, at + 1, 1) + 2) * 4).when(kind == 44, 8).otherwise((_number(h, at + 1, 1) + 1) * 8)
        later = (kind == 44) & (_number(h, at + 2, 2) >= 8)
        passed = F.struct((at + length).alias("at"), F.when(later, 59).otherwise(_number(h, at, 1)).alias("next"))
        return F.when(kind.isin(44, 51, *counted), passed).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(0), (size / 8).cast("int")), start, step)
    return F.when(following.isin(44, 51, *counted), walked).otherwise(start)


def transport(frames: DataFrame) -> DataFrame:
    """TCP or UDP over IPv4 or IPv6 on Ethernet; all other frames are dropped.

    Stacked VLAN tags, PPPoE sessions and IPv6 extension headers are passed over;
    of a fragmented packet only the first fragment has ports.  Adds addresses,
    ports, proto, srcMac and ``body``, the byte offset of the transport payload.
    """
    eth = frames.where(F.col("linktype") == ETHERNET)
    kind, following = F.hex(F.substring("payload", 13, 2)), F.hex(F.substring("payload", 21, 1))
    plain = (kind == "0800") | ((kind == "86DD") & following.isin("06", "11"))
    size = F.length("payload")
    # headers of a plain frame end within the first 160 bytes: link 14, network 60, transport 60
    eth = derive_once(eth, {"_size": size, "_h": F.hex(F.substring("payload", F.lit(1), F.when(plain, 160).otherwise(size)))})
    tags = F.regexp_extract(F.substring("_h", 25, 1 << 20), r"^(?:(?:8100|88A8|9100)[0-9A-F]{4})*", 0)
    eth = derive_once(eth, {"_type": (F.length(tags) / 2).cast("int") + 12})
    outer = F.substring(F.col("_h"), F.col("_type") * 2 + 1, F.lit(4))
    inner = F.substring(F.col("_h"), F.col("_type") * 2 + 17, F.lit(4))
    session = F.when(inner == "0021", "0800").when(inner == "0057", "86DD")
    eth = derive_once(eth, {
        "_kind": F.when(outer == "8864", session).otherwise(outer),
        "_l3": F.col("_type") + F.when(outer == "8864", 10).otherwise(2),
    })
    kind, l3 = F.col("_kind"), F.col("_l3")
    first = _number(F.col("_h"), l3, 1)
    unfragmented = F.pmod(_number(F.col("_h"), l3 + 6, 2), F.lit(8192)) == 0
    v4 = (kind == "0800") & (F.shiftright(first, 4) == 4) & unfragmented
    v6 = (kind == "86DD") & (F.shiftright(first, 4) == 6)
    net = derive_once(eth, {"_fam": F.when(v4, 4).when(v6, 6), "_first": first})
    net = derive_once(net, {
        "_ext": F.when(F.col("_fam") == 6, _past_extensions(F.col("_h"), l3 + 40, _number(F.col("_h"), l3 + 6, 1), F.col("_size"))),
    })
    net = derive_once(net, {
        "_l4": F.when(F.col("_fam") == 4, l3 + F.pmod("_first", F.lit(16)) * 4).otherwise(F.col("_ext.at")),
        "_proto": F.when(F.col("_fam") == 4, _number(F.col("_h"), l3 + 9, 1)).otherwise(F.col("_ext.next")),
    })
    net = net.where(
        ((F.col("_proto") == 6) & (F.col("_size") >= F.col("_l4") + 20))
        | ((F.col("_proto") == 17) & (F.col("_size") >= F.col("_l4") + 8))
    )
    four, l4, h = F.col("_fam") == 4, F.col("_l4"), F.col("_h")

    def address(v4_at: int, v6_at: int) -> Column:
        return F.when(
            four, F.concat(F.lit("4"), F.substring(h, (l3 + v4_at) * 2 + 1, F.lit(8)))
        ).otherwise(F.concat(F.lit("6"), F.substring(h, (l3 + v6_at) * 2 + 1, F.lit(32))))

    tcp = F.col("_proto") == 6
    keyed = derive_once(net, {
        "srcKey": address(12, 8),
        "destKey": address(16, 24),
        "srcPort": _number(h, l4, 2),
        "destPort": _number(h, l4 + 2, 2),
        "proto": F.when(tcp, "tcp").otherwise("udp"),
        "srcMac": F.lower(F.substring(h, 13, 12)),
        "body": l4 + F.when(tcp, F.shiftright(_number(h, l4 + 12, 1), 4) * 4).otherwise(8),
    })
    # an address in mapped form is an IPv4 address
    keyed = keyed.withColumns({k: unmapped_key(F.col(k)) for k in ("srcKey", "destKey")})
    keyed = keyed.withColumns({"srcIP": key_text("srcKey"), "destIP": key_text("destKey")})
    return keyed.drop("_h", "_type", "_kind", "_l3", "_l4", "_first", "_ext", "_fam", "_proto", "_size")


def frames_ip(frames: DataFrame) -> DataFrame:
    """One connection row per frame; its byte count is the captured length."""
    return transport(frames).select(
        "ts", "srcPort", "destPort", "proto", F.length("payload").cast("bigint").alias("bytesCount"),
        F.lit("unknown").alias("direction"), F.lit(None).cast("string").alias("ja3"),
        "srcIP", "srcKey", "destIP", "destKey", "srcMac", "source_file",
    )


def _question(message: bytes) -> tuple[str | None, int | None]:
    """Name and type number of the first question of a DNS message."""
    labels, at, after, seen = [], 12, None, set()
    while at < len(message):
        size = message[at]
        if size == 0:
            after = at + 1 if after is None else after
            if after + 4 > len(message):
                return None, None
            return ".".join(labels), message[after] << 8 | message[after + 1]
        if size >= 0xC0:
            # a pointer met twice leads in a circle
            if at + 1 >= len(message) or at in seen:
                return None, None
            seen.add(at)
            after = at + 2 if after is None else after
            at = (size & 0x3F) << 8 | message[at + 1]
            continue
        labels.append(message[at + 1 : at + 1 + size].decode("latin-1"))
        at += 1 + size
    return None, None


@F.pandas_udf(_QUESTION)
def dns_question(messages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if m is None else _question(bytes(m)) for m in messages], columns=["query", "type"]).astype({"type": "Int32"})


def _asked(rows: DataFrame) -> DataFrame:
    """Adds the message that may be a DNS query (else NULL) as ``_m``."""
    # over TCP two length bytes come first
    start = F.col("body") + F.when(F.col("proto") == "tcp", 3).otherwise(1)
    at_53 = (F.col("srcPort") == 53) | (F.col("destPort") == 53)
    rows = derive_once(rows, {"_m": F.when(at_53, F.substring(F.col("payload"), start, F.length("payload")))})
    head = F.hex(F.substring("_m", 1, 12))
    is_query = (F.length("_m") >= 17) & (_number(head, 2, 1) < 128) & (_number(head, 4, 2) > 0)
    return derive_once(rows, {"_m": F.when(is_query, F.col("_m"))})


def frames_dns(frames: DataFrame) -> DataFrame:
    """DNS queries (not answers) to or from port 53, first question only."""
    rows = _asked(transport(frames)).where(F.col("_m").isNotNull()).withColumn("_q", dns_question("_m"))
    return rows.where(F.col("_q.query").isNotNull()).select(
        "ts", "srcPort", "destPort", "proto", F.col("_q.query").alias("query"),
        dns_type_name("_q.type").alias("qtype"), "srcIP", "srcKey", "destIP", "destKey", "source_file",
    )


def frames_all(frames: DataFrame, kinds: list[str]) -> DataFrame:
    """Connections and DNS queries of the frames, whose headers are read once: ``event_type`` and the columns of both."""
    rows = transport(frames)
    both = {"ip": F.lit(True), "dns": F.lit(False)}
    if "dns" in kinds:
        rows = _asked(rows).withColumn("_q", dns_question("_m"))
        rows = derive_once(rows, {"query": F.col("_q.query"), "qtype": dns_type_name("_q.type")}).drop("_q", "_m")
        both["dns"] = F.col("query").isNotNull()
    rows = rows.withColumn("event_type", F.explode(F.array_compact(F.array(*[F.when(both[k], F.lit(k)) for k in kinds]))))
    ip = F.col("event_type") == "ip"
    asked = [F.when(~ip, F.col(c)).alias(c) for c in ("query", "qtype")] if "dns" in kinds else []
    return rows.select(
        "event_type", "ts", "srcPort", "destPort", "proto", F.when(ip, F.length("payload").cast("bigint")).alias("bytesCount"),
        F.when(ip, F.lit("unknown")).alias("direction"), F.lit(None).cast("string").alias("ja3"), *asked,
        "srcIP", "srcKey", "destIP", "destKey", "srcMac", "source_file",
    )
