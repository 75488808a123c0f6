"""Captures are built from finished records and read without the columns nobody wants."""

import struct
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from test_capture_ranges import classic, some_frames
from wirelight.plans.log_queries import _captures, _udp_body
from wirelight.sources import capture_ranges
from wirelight.sources.capture_ranges import FRAME, HEAD, SPLIT, TAIL, _splits

_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _rows(spark):
    row = lambda key, n, src, size, us=0: (key, n, _START + timedelta(microseconds=us), src, "8.8.8.8", 1025, 53, size)
    rows = [row(1, 3, "10.0.0.1", 2, 7), row(1, 1, "10.0.0.2", 1, 10), row(1, 1, "10.0.0.1", 1, 10), row(1, 1, "10.0.0.2", 1, 10), row(1, None, "fd00::1", 0),
            row(1, 2, "no address", 1), row(1, 2, "10.0.0.9", None), row(2, 1, "10.0.0.9", None), row(3, 1, None, 1), row(None, 5, "10.0.0.3", 1)]
    return spark.createDataFrame(rows, "capture bigint, conn_id bigint, ts timestamp, srcIP string, destIP string, srcPort int, destPort int, bytesCount bigint").repartition(3)


def _v4(last, size, us):
    udp = struct.pack(">HHHH", 1025, 53, 8, 0) + b"\xab" * size
    net = bytes.fromhex("4500") + struct.pack(">H", 20 + len(udp)) + bytes.fromhex("000100004011000" + "0" + f"0a0000{last:02x}" + "08080808")
    return int(_START.timestamp()), us, bytes.fromhex("020000000099" + "020000000001" + "0800") + net + udp


def test_records_are_joined_in_order(spark):
    """Repeated and NULL numbers, rows without a record, a capture of nothing else, a NULL key."""
    found = {r.path: bytes(r.content) for r in _captures(_rows(spark), "capture", "conn_id", _udp_body(), 17).collect()}
    plain = lambda frames: struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", s, us, len(f), len(f)) + f for s, us, f in frames)
    six = (int(_START.timestamp()), 0, bytes.fromhex("020000000099" + "020000000001" + "86dd" + "60000000" + "0008" + "1140" + "fd00" + "00" * 13 + "01"
                                                     + "00" * 10 + "ffff" + "08080808" + "0401" + "0035" + "0008" + "0000"))
    assert found == {"1": plain([six, _v4(1, 1, 10), _v4(2, 1, 10), _v4(2, 1, 10), _v4(1, 2, 7)]), "2": plain([]), None: plain([_v4(3, 1, 0)])}


def test_records_are_not_worked_out_inside_an_aggregate(spark):
    """An aggregate of objects isn't compiled: it worked out the whole frame's text row by row."""
    plan = _captures(_rows(spark), "capture", "conn_id", _udp_body(), 17)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_only_the_ends_are_read_for_the_ends(spark, tmp_path, monkeypatch):
    """The few heads and tails are found without the frames' bytes."""
    plans, kept = {}, capture_ranges.materialise

    def materialise(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(capture_ranges, "materialise", materialise)
    (tmp_path / "a.pcap").write_bytes(classic(some_frames(500, 1)))
    sizes = capture_ranges.capture_rows(spark, str(tmp_path)).select("frame_no", "captured")
    read = [line for line in plans["ends"].splitlines() if "ReadSchema" in line]
    assert read and not [line for line in read if "body:binary" in line]
    assert [r.captured for r in sizes.orderBy("frame_no").collect()] == [len(f[2]) for f in some_frames(500, 1)]


def test_a_split_counts_its_rows():
    """The last row of a split says what it holds, so that nobody has to group all frames."""
    import pyarrow as pa

    data = classic(some_frames(300, 4))
    batch = lambda file, block, last, part: [(file, block, last, line) for line in part.split(b"\n")]
    rows = [*batch("a", 0, True, data), *batch("b", 0, False, data[:5000]), *batch("b", 5000, True, data[5000:]), *batch("c", 7, True, b"\xff" * 30), *batch("d", 0, True, data[:24])]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    cut = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 70]), kinds)], names=["f", "b", "l", "v"]) for lo in range(0, len(rows), 70)]
    made = [r for b in _splits(iter(cut)) for r in b.to_pylist()]
    for split in {(r["source_file"], r["block"]) for r in made}:
        mine = [r for r in made if (r["source_file"], r["block"]) == split]
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        count = lambda kind: sum(r["kind"] == kind for r in mine)
        *_, last = mine
        frames = [r["seq"] for r in mine if r["kind"] == FRAME]
        assert last["kind"] == SPLIT and (last["original"], last["fraction"]) == (count(HEAD), len(frames))
        assert not frames or last["seconds"] == frames[0]
        assert (last["order"] is not None) == (count(FRAME) + count(TAIL) > 0)
    assert sum(r["kind"] == FRAME for r in made if r["source_file"] == "a") == 300
