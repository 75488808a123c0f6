"""Captures cut into ranges give the frames of one task."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from test_captures import _blocks
from wirelight.sources.capture_ranges import capture_rows, pcap_frames, resync
from wirelight.sources.lines import split_errors

MAGIC = {("<", 1): 0xA1B2C3D4, ("<", 1000): 0xA1B23C4D, (">", 1): 0xA1B2C3D4, (">", 1000): 0xA1B23C4D}


def classic(frames, order="<", units=1, link=1, snap=65535):
    """(seconds, micros, bytes) as a capture file."""
    out = struct.pack(order + "IHHiIII", MAGIC[order, units], 2, 4, 0, 0, snap, link)
    for s, us, body in frames:
        out += struct.pack(order + "IIII", s, us * units, len(body), len(body) + s % 3) + body
    return out


def some_frames(n, seed, least=14, most=400):
    rng = random.Random(seed)
    return [(1_700_000_000 + i // 7, rng.randrange(1_000_000), bytes(rng.choice([10, 10, 0, rng.randrange(256)]) for _ in range(rng.randrange(least, most)))) for i in range(n)]


@pytest.fixture
def cut(spark):
    """Sets how many bytes a split has."""
    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(spark, path):
    found = {}
    for r in capture_rows(spark, str(path)).orderBy("source_file", "frame_no").collect():
        found.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.frame_no, r.micros, r.linktype, r.payload and bytes(r.payload), r._error))
    return found


def _wanted(frames, link=1):
    return [(i, s * 1_000_000 + us, link, body, None) for i, (s, us, body) in enumerate(frames)]


@pytest.mark.parametrize("size", [700, 5_000, 1 << 27])
def test_any_cut_gives_all_frames_in_order(spark, tmp_path, cut, size):
    a, b, c = some_frames(300, 1), some_frames(120, 2, most=3000), some_frames(40, 3)
    files = {"a.pcap": classic(a), "b.pcap": classic(b, ">", 1000, 113), "none.pcap": classic([]), "ends-in-ten.pcap": classic([*c, (c[-1][0], 1, b"xx\n")])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed.pcap.gz").write_bytes(gzip.compress(classic(c)))
    (tmp_path / "blocks.pcapng").write_bytes(_blocks([f[2] for f in c]))
    cut(size)
    found = _rows(spark, tmp_path)
    assert found["a.pcap"] == _wanted(a)
    assert found["b.pcap"] == _wanted(b, 113)
    assert found["packed.pcap.gz"] == _wanted(c)
    assert found["ends-in-ten.pcap"] == _wanted([*c, (c[-1][0], 1, b"xx\n")])
    assert [r[3] for r in found["blocks.pcapng"]] == [f[2] for f in c] and "none.pcap" not in found


def test_a_capture_inside_a_frame_doesn_t_mislead(spark, tmp_path, cut):
    """A frame that holds a long chain of frame headers: a split that begins there finds the wrong chain, and the file is read in order."""
    inner = classic(some_frames(200, 4))[24:]
    frames = [*some_frames(5, 5), (1_700_000_000, 7, b"\n" + inner + b"\n"), *some_frames(50, 6)]
    (tmp_path / "x.pcap").write_bytes(classic(frames))
    cut(9_000)
    assert resync(inner[100:]) is not None
    assert _rows(spark, tmp_path)["x.pcap"] == _wanted(frames)


def test_broken_files(spark, tmp_path, cut):
    frames = some_frames(60, 7)
    whole = classic(frames)
    files = {"cut.pcap": whole[:-30], "head.pcap": whole[:15], "text.pcap": b"no capture at all\nat all", "ng.pcap": _blocks([f[2] for f in frames])[:-40], "good.pcap": whole}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    cut(2_000)
    good, bad = split_errors(pcap_frames(spark, str(tmp_path), "keep"))
    counts = {r.f: r.n for r in good.groupBy(F.substring_index("source_file", "/", -1).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert counts == {"cut.pcap": 59, "good.pcap": 60, "ng.pcap": 59}
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in bad.collect()) == ["cut.pcap", "head.pcap", "ng.pcap", "text.pcap"]
    with pytest.raises(Exception, match="not a capture"):
        pcap_frames(spark, str(tmp_path)).count()
    assert pcap_frames(spark, str(tmp_path), "skip").count() == 178


def test_one_file_is_spread_over_tasks(spark, tmp_path, cut):
    (tmp_path / "a.pcap").write_bytes(classic(some_frames(2000, 8)))
    cut(50_000)
    table = capture_rows(spark, str(tmp_path))
    assert table.count() == 2000
    assert not [r for r in table.where("_error IS NOT NULL").collect()]


def test_resync_finds_the_next_frame():
    frames = some_frames(40, 9)
    data = classic(frames)
    starts, at = [], 24
    for *_, body in frames:
        starts.append(at)
        at += 16 + len(body)
    for start in range(25, starts[-8], 97):
        found = resync(data[start:])
        assert found == (min(s for s in starts if s >= start) - start, "<")
    assert resync(b"") is None and resync(bytes(5000)) is None and resync(b"\xff" * 5000) is None
