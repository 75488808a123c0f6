"""Suppression of repeated queries that is carried over micro-batches."""

import glob
import json
import os
from collections import deque

import pytest
from pyspark.sql import functions as F

from wirelight.operators.dedup import dedup_horizon, keep_unlike_recent
from wirelight.streaming.jobs import horizon_dedup, stateful_dedup, tail_to_events


def _streamed(spark, folder, batches, start):
    """Runs a job once after each batch of files has landed."""
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
        start(stream).awaitTermination()


def test_last_eight_over_shuffled_files(spark, tmp_path):
    """Two sensors, 24,000 rows each, in shuffled order over several files and two batches."""
    rows = spark.range(48_000).select(
        "id", F.when(F.col("id") % 2 == 0, "a").alias("sensor"), (F.xxhash64("id") % 12).alias("q"))
    shuffled = [rows.where("id < 30000").orderBy(F.hash("id")).repartition(4), rows.where("id >= 30000").orderBy(F.hash("id")).repartition(4)]
    out = f"{tmp_path}/out"
    _streamed(spark, str(tmp_path), shuffled, lambda s: stateful_dedup(s, "sensor", ["id"], ["q"], out, f"{tmp_path}/check", once=True))
    wanted = []
    for sensor in ("a", None):
        mine = [r for r in rows.orderBy("id").collect() if r.sensor == sensor]
        fresh = keep_unlike_recent(deque(maxlen=8), [r.q for r in mine])
        wanted += [r.id for r, f in zip(mine, fresh, strict=True) if f]
    found = [r.id for r in spark.read.parquet(out).select("id").collect()]
    assert 1000 < len(wanted) < 48_000
    assert sorted(found) == sorted(wanted)


def _timed(spark, rows):
    return spark.createDataFrame(rows, "id int, q string, s double").select("id", "q", F.timestamp_seconds("s").alias("ts"))


def test_horizon_at_slot_edges_and_over_batches(spark, tmp_path):
    """:29 and :31 are two seconds apart, also if they come in two batches."""
    first = _timed(spark, [(1, "x", 29.0), (2, "x", 31.0), (3, "y", 10.0), (4, None, 5.0)])
    second = _timed(spark, [(5, "x", 60.0), (6, "y", 100.0), (7, None, 6.0), (8, "z", 101.0), (9, "x", 95.0)])
    out = f"{tmp_path}/out"
    _streamed(spark, str(tmp_path), [first, second], lambda s: horizon_dedup(s, ["q"], out, f"{tmp_path}/check", ["id"], once=True))
    found = sorted(r.id for r in spark.read.parquet(out).collect())
    whole = sorted(r.id for r in dedup_horizon(first.union(second), ["q"], ["id"]).collect())
    assert found == whole == [1, 3, 4, 6, 8, 9]


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Rows days behind the newest can't be judged; none is lost."""
    day = 86_400.0
    first, second = _timed(spark, [(1, "x", 10 * day)]), _timed(spark, [(2, "late", 10.0), (3, "x", 5.0), (4, "x", 10 * day + 3), (5, "y", 10 * day - 3500), (6, "z", None)])
    out = f"{tmp_path}/out"
    _streamed(spark, str(tmp_path), [first, second], lambda s: horizon_dedup(s, ["q"], out, f"{tmp_path}/check", once=True))
    assert sorted((r.id, r.late == "true") for r in spark.read.parquet(out).collect()) == [(1, False), (2, True), (3, True), (5, False), (6, True)]


def test_rows_out_of_order_are_judged_by_all_that_came_before(spark, tmp_path):
    batches = [[(1, "x", 1000.0), (2, "x", 1100.0)], [(3, "x", 1020.0), (4, "x", 1060.0), (5, "x", 1085.0)], [(6, "x", 1135.0), (7, "x", 1115.0), (8, "x", 990.0), (9, "x", 1145.0)]]
    out = f"{tmp_path}/out"
    _streamed(spark, str(tmp_path), [_timed(spark, b) for b in batches], lambda s: horizon_dedup(s, ["q"], out, f"{tmp_path}/check", ["id"], once=True))
    # 1020 follows 1000; 1060 is on its own, 1085 follows it; 1115 follows 1100, 1135 follows 1115, 1145 follows 1135
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 4, 8]


def _state(query):
    query.awaitTermination()
    return query.recentProgress


def test_a_key_expires_without_new_rows(spark, tmp_path):
    """500 keys, then one other key hours later: their timers fire, though nothing more comes for them."""
    many = _timed(spark, [(i, f"k{i}", float(i)) for i in range(500)])
    later = [_timed(spark, [(1000 + i, "clock", 40_000.0 + i)]) for i in range(2)]
    progress = []
    _streamed(spark, str(tmp_path), [many, *later], lambda s: _Waiter(horizon_dedup(s, ["q"], f"{tmp_path}/out", f"{tmp_path}/check", once=True), progress))
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    updates = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert max(totals) >= 500 and totals[-1] < 10
    # the last batch touches one key, not the 500 that came before
    assert updates[0] >= 500 and updates[-1] < 10
    assert spark.read.parquet(f"{tmp_path}/out").count() == 501


class _Waiter:
    def __init__(self, query, progress):
        self.query, self.progress = query, progress

    def awaitTermination(self):
        self.progress += _state(self.query)


def test_a_batch_that_runs_again_neither_loses_nor_doubles(spark, tmp_path):
    """The commit of the last batch is gone, as after a crash between its output and its commit."""
    rows = spark.range(4000).select("id", F.lit("s").alias("sensor"), (F.xxhash64("id") % 12).alias("q"))
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    _streamed(spark, str(tmp_path), [rows.where("id < 2000"), rows.where("id >= 2000")], lambda s: stateful_dedup(s, "sensor", ["id"], ["q"], out, check, once=True))
    once = sorted(r.id for r in spark.read.parquet(out).collect())
    last = max(glob.glob(f"{check}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for file in (last, f"{check}/commits/.{os.path.basename(last)}.crc"):
        if os.path.exists(file):
            os.unlink(file)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stateful_dedup(stream, "sensor", ["id"], ["q"], out, check, once=True).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == once
    fresh = keep_unlike_recent(deque(maxlen=8), [r.q for r in rows.orderBy("id").collect()])
    assert once == [i for i, f in enumerate(fresh) if f]


def test_rows_keep_their_types_through_the_state(spark, tmp_path):
    schema = "id long, ts timestamp, day date, n decimal(20,3), tags array<string>, at map<string,int>, raw binary, big bigint, q string"
    rows = spark.sql("SELECT 1L, TIMESTAMP '2024-05-01 10:00:00.123456', DATE '2024-01-02', CAST(1.5 AS DECIMAL(20,3)), array('a', NULL), map('k', 3), X'00FF', 9007199254740993L, 'x'"
                     " UNION ALL SELECT 2L, TIMESTAMP '2024-05-01 11:00:00', NULL, NULL, NULL, NULL, NULL, NULL, NULL").toDF(*[c.split(" ")[0] for c in schema.split(", ")])
    _streamed(spark, str(tmp_path / "a"), [rows], lambda s: stateful_dedup(s, "q", ["id"], ["q"], f"{tmp_path}/o1", f"{tmp_path}/c1", once=True))
    _streamed(spark, str(tmp_path / "b"), [rows], lambda s: horizon_dedup(s, ["q"], f"{tmp_path}/o2", f"{tmp_path}/c2", once=True))
    wanted = sorted(rows.collect())
    assert sorted(spark.read.schema(rows.schema).parquet(f"{tmp_path}/o1").collect()) == wanted
    assert sorted(spark.read.parquet(f"{tmp_path}/o2").where("NOT late").select(*rows.columns).collect()) == wanted


@pytest.mark.parametrize("name", ["edge", "pcap"])
def test_tailing_takes_text_formats_only(spark, tmp_path, name):
    with pytest.raises(ValueError, match="tailed"):
        tail_to_events(spark, str(tmp_path), name, "dns", [], f"{tmp_path}/o", f"{tmp_path}/c", once=True)


@pytest.mark.parametrize(("rule", "wanted"), [("horizon", ["a.org 0", "a.org 50", "b.org 7"]), ("last8", ["a.org 0", "b.org 7"])])
def test_tailing_suppresses_repeats_across_batches(spark, tmp_path, rule, wanted):
    (tmp_path / "in").mkdir()
    rec = lambda q, s: json.dumps({"timestamp": f"2024-05-01T10:00:{s:02d}.000000+0000", "src_ip": "10.0.0.1", "proto": "UDP", "dns": {"type": "query", "rrname": q, "rrtype": "A"}})
    for n, lines in enumerate(([rec("a.org", 0), rec("a.org", 5), "{bad"], [rec("b.org", 7), rec("a.org", 12)], [rec("a.org", 50)])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        tail_to_events(spark, f"{tmp_path}/in", "suricata", "dns", [], f"{tmp_path}/out", f"{tmp_path}/check", once=True, repeats=rule).awaitTermination()
    found = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(f"{e['query']} {int(e['ts'][17:19])}" for e in found) == wanted
    with pytest.raises(ValueError, match="line by line"):
        tail_to_events(spark, f"{tmp_path}/in", "bro", "dns", [], f"{tmp_path}/o2", f"{tmp_path}/c2", once=True, repeats=rule)


def test_a_sensor_with_all_rows_of_a_batch_is_spread(spark, tmp_path):
    """Two batches of one busy sensor and a few small ones: its rows are judged by several tasks, as the chain over both batches says."""
    sensor = F.when(F.col("id") % 400 == 7, F.concat(F.lit("s"), F.expr("id % 3"))).otherwise("busy")
    rows = spark.range(60_000).select("id", sensor.alias("sensor"), F.when(F.col("id") % 9 != 0, F.xxhash64("id") % 13).alias("q"))
    batches = [rows.where("id < 35000"), rows.where("id >= 35000 AND sensor <> 's1'"), rows.where("id >= 35000 AND sensor = 's1'")]
    _streamed(spark, str(tmp_path), batches, lambda s: stateful_dedup(s, "sensor", ["id"], ["q"], f"{tmp_path}/out", f"{tmp_path}/check", once=True))
    seen, wanted = {}, []
    for r in rows.orderBy("id").collect():
        if keep_unlike_recent(seen.setdefault(r.sensor, deque(maxlen=8)), [r.q])[0]:
            wanted.append(r.id)
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in kept.collect()) == wanted
    assert kept.columns == rows.columns
    # a group that is one task's is one file's
    assert kept.where("sensor = 'busy' AND id < 35000").select(F.input_file_name()).distinct().count() > 2
