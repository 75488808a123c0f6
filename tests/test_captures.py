"""Capture kinds, broken captures, and the headers in front of the transport layer."""

import pytest
from pyspark.sql import functions as F

from wirelight.sources.lines import split_errors
from wirelight.sources.pcap import frames_ip, split_captures


def _udp(src, dst):
    return bytes.fromhex(f"{src:04x}{dst:04x}00080000")


_SIX = bytes.fromhex("fd00" + "00" * 13 + "01" + "fd00" + "00" * 13 + "02")


def _ip6(following, body):
    return bytes.fromhex("60000000") + len(body).to_bytes(2, "big") + bytes([following, 64]) + _SIX + body


def _ip4(body):
    return bytes.fromhex(f"4500{20 + len(body):04x}0001000040110000" + "0a000001" + "08080808") + body


_MACS = bytes(6) + bytes.fromhex("020000000001")


def _odd_frames():
    """Frames whose transport lies behind tags, sessions and extension headers; the last two have none."""
    pad = lambda kind, units=0: bytes([kind, units]) + bytes(6 + 8 * units)
    session = bytes.fromhex("8864") + bytes.fromhex("110000010000")
    return [
        _MACS + bytes.fromhex("88a80001" + "81000002" + "81000003" + "0800") + _ip4(_udp(1, 53)),
        _MACS + session + bytes.fromhex("0021") + _ip4(_udp(2, 53)),
        _MACS + bytes.fromhex("81000007") + session + bytes.fromhex("0057") + _ip6(17, _udp(3, 53)),
        _MACS + bytes.fromhex("86dd") + _ip6(0, pad(60, 1) + pad(43) + pad(17, 20) + _udp(4, 53)),
        _MACS + bytes.fromhex("86dd") + _ip6(44, bytes.fromhex("1100000100000009") + _udp(5, 53)),
        _MACS + bytes.fromhex("86dd") + _ip6(51, bytes.fromhex("1104") + bytes(22) + _udp(6, 53)),
        _MACS + bytes.fromhex("86dd") + _ip6(44, bytes.fromhex("1100001000000009") + _udp(7, 53)),
        _MACS + bytes.fromhex("86dd") + _ip6(0, bytes([0, 0]) + bytes(6)),
    ]


def _blocks(frames, order="little", resolution=None):
    """A pcapng file with one interface."""
    n = lambda x, size: x.to_bytes(size, order)
    block = lambda kind, body: n(kind, 4) + n(12 + len(body), 4) + body + n(12 + len(body), 4)
    option = b"" if resolution is None else n(9, 2) + n(1, 2) + bytes([resolution, 0, 0, 0]) + bytes(4)
    out = block(0x0A0D0D0A, n(0x1A2B3C4D, 4) + n(1, 2) + n(0, 2) + b"\xff" * 8) + block(1, n(1, 2) + n(0, 2) + n(0, 4) + option)
    for i, f in enumerate(frames):
        ticks = (1_000_000 + i) * (1000 if resolution == 9 else 1)
        out += block(6, n(0, 4) + n(ticks >> 32, 4) + n(ticks & 0xFFFFFFFF, 4) + n(len(f), 4) * 2 + f + bytes(-len(f) % 4)) + block(4, b"")
    return out


def test_headers_before_transport(spark):
    files = spark.createDataFrame([("a", bytearray(_blocks(_odd_frames())))], "path string, content binary")
    rows = frames_ip(split_captures(files)).orderBy("srcPort").collect()
    assert [r.srcPort for r in rows] == [1, 2, 3, 4, 5, 6] and {r.destPort for r in rows} == {53}
    assert [r.srcIP for r in rows] == ["10.0.0.1"] * 2 + ["fd00::1"] * 4


def test_capture_kinds_and_broken_files(spark):
    import struct

    frames = _odd_frames()[:3]
    classic = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, i, len(f), len(f)) + f for i, f in enumerate(frames))
    files = {"classic": classic, "little": _blocks(frames), "big": _blocks(frames, "big", 9), "cut": classic[:-1], "ng-cut": _blocks(frames)[:-3],
             "empty": b"", "text": b"no capture", "head": classic[:10]}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    good, bad = split_errors(split_captures(df, "keep"))
    found = {}
    for r in good.select("source_file", F.unix_micros("ts").alias("us"), "payload").collect():
        found.setdefault(r.source_file, []).append((r.us, bytes(r.payload)))
    whole = [(1_000_000 + i, f) for i, f in enumerate(frames)]
    assert {k: sorted(v) for k, v in found.items()} == {"classic": whole, "little": whole, "big": whole, "cut": whole[:2], "ng-cut": whole}
    assert sorted(r.source_file for r in bad.collect()) == ["cut", "empty", "head", "ng-cut", "text"]
    assert split_captures(df, "skip").count() == 14
    with pytest.raises(Exception, match="pcap"):
        split_captures(df).count()
    assert split_captures(df.where("path in ('cut', 'head', 'classic')")).count() == 5


def test_question_behind_many_pointers():
    from wirelight.sources.pcap import _question

    chain = b"".join((0xC000 | (12 + 2 * (i + 1))).to_bytes(2, "big") for i in range(40))
    # the first pointer ends the name; type and class follow it in a real message, here they are the next pointer
    assert _question(bytes(12) + chain + b"\x03abc\x00")[0] == "abc"
    assert _question(bytes(12) + b"\xc0\x0c" + bytes(4)) == (None, None)
