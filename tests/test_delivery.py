"""Documents followed by files, and events that wait for a sink."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wirelight.sources.scope_file import ScopeGroup
from wirelight.sources.search_config import Search
from wirelight.streaming.jobs import follow_documents, publish, stream_documents
from wirelight.streaming.outbox import deliver_stream, replay_unsent, unsent

NOW = dt.datetime(2024, 5, 1, 10, 0, tzinfo=dt.timezone.utc)
GROUPS = [ScopeGroup("g", in_scope=("10.0.0.0/8",))]


def _landed(spark, folder, docs):
    """(id, ingested as hh:mm:ss.ffffff, query) as landed documents."""
    rows = [(i, json.dumps({"source": {"ip": "10.0.0.1"}, "dns": {"question": {"name": q}}}),
             {"@timestamp": [f"2024-05-01T{t}Z"], "event.ingested": [f"2024-05-01T{t}Z"]}, f"2024-05-01 {t}") for i, t, q in docs]
    frame = spark.createDataFrame(rows, "id string, source string, fields map<string,array<string>>, t string")
    frame.select("id", "source", "fields", F.col("t").cast("timestamp").alias("ingested")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _follow(spark, folder, **more):
    follow_documents(stream_documents(spark, f"{folder}/in"), Search("dns", "ecs"), GROUPS, f"{folder}/out", f"{folder}/check", NOW, once=True, **more).awaitTermination()
    return sorted(json.loads(r.value)["query"] for r in spark.read.text(f"{folder}/out").collect())


def test_document_that_lands_late_with_a_time_already_seen(spark, tmp_path):
    at = "10:00:07.250000"
    _landed(spark, tmp_path, [("1", at, "a.org"), ("2", "09:00:00.000000", "older-than-the-start.org"), ("3", "09:56:00.000000", "b.org")])
    assert _follow(spark, tmp_path) == ["a.org", "b.org"]
    # the newest time once more: a new document, one that comes again, and an earlier one
    _landed(spark, tmp_path, [("4", at, "late.org"), ("1", at, "a.org"), ("5", "10:00:01.000000", "earlier.org")])
    assert _follow(spark, tmp_path) == ["a.org", "b.org", "earlier.org", "late.org"]
    assert _follow(spark, tmp_path) == ["a.org", "b.org", "earlier.org", "late.org"]


def test_restart_after_a_failed_write(spark, tmp_path):
    _landed(spark, tmp_path, [(str(i), f"10:00:{i:02d}.000000", f"n{i}.org") for i in range(20)])

    def half(entries, event_type, out, batch_id):
        publish(entries.where("query < 'n2'"), event_type, out, batch_id)
        raise OSError("disk full")

    with pytest.raises(Exception, match="disk full"):
        _follow(spark, tmp_path, write=half)
    _landed(spark, tmp_path, [("x", "10:00:03.000000", "x.org")])
    assert _follow(spark, tmp_path) == sorted([f"n{i}.org" for i in range(20)] + ["x.org"])


class Sink:
    """Keeps the newest content per stream and batch; fails the first `fails` times, half-way through."""

    def __init__(self, fails):
        self.fails, self.got = fails, {}

    def __call__(self, entries, event_type, stream, batch_id):
        rows = [r.query for r in entries.select("query").collect()]
        if self.fails:
            self.fails -= 1
            self.got[event_type, stream, batch_id] = rows[: len(rows) // 2]
            raise ConnectionError("reset")
        self.got[event_type, stream, batch_id] = rows

    def all(self):
        return sorted(q for rows in self.got.values() for q in rows)


def _entries(spark, folder, names):
    frame = spark.createDataFrame([(q,) for q in names], "query string").select(
        F.lit(NOW).cast("timestamp").alias("ts"), F.lit("10.0.0.1").alias("srcIP"), "query", F.lit("A").alias("qtype"))
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _deliver(spark, folder, names, sink, tries=3):
    stream = _entries(spark, folder, names)
    deliver_stream(stream, "dns", sink, f"{folder}/box", f"{folder}/check", tries=tries, wait=0.01, once=True).awaitTermination()


def test_a_sink_that_is_down_leaves_every_event(spark, tmp_path):
    down, names = Sink(10**9), [[f"{b}-{i}.org" for i in range(30)] for b in range(3)]
    for batch in names:
        _deliver(spark, tmp_path, batch, down)
    waiting = unsent(spark, f"{tmp_path}/box", "dns")
    assert sorted(r.query for r in waiting.collect()) == sorted(sum(names, []))
    assert {r._error for r in waiting.collect()} == {"ConnectionError: reset"} and waiting.select("batch_id").distinct().count() == 3
    assert replay_unsent(spark, f"{tmp_path}/box", "dns", down, tries=1) == (0, 3)
    back = Sink(2)
    assert replay_unsent(spark, f"{tmp_path}/box", "dns", back, tries=1) == (1, 2)
    assert replay_unsent(spark, f"{tmp_path}/box", "dns", back, tries=1) == (2, 0)
    assert back.all() == sorted(sum(names, [])) and len(back.got) == 3
    assert unsent(spark, f"{tmp_path}/box", "dns") is None
    assert replay_unsent(spark, f"{tmp_path}/box", "dns", back) == (0, 0)


def test_a_sink_that_fails_at_first_is_tried_again(spark, tmp_path):
    sink = Sink(2)
    _deliver(spark, tmp_path, ["a.org", "b.org"], sink)
    assert sink.all() == ["a.org", "b.org"] and unsent(spark, f"{tmp_path}/box", "dns") is None


def test_outbox_of_a_batch_that_is_sent_after_a_crash_is_emptied(spark, tmp_path):
    """The batch was put aside, then the job died before its commit: the batch runs again and is sent."""
    _deliver(spark, tmp_path, ["a.org", "b.org"], Sink(10**9))
    for file in (tmp_path / "check" / "commits").iterdir():
        file.unlink()
    sink = Sink(0)
    _deliver(spark, tmp_path, ["c.org"], sink)
    assert sink.all() == ["a.org", "b.org", "c.org"] and unsent(spark, f"{tmp_path}/box", "dns") is None
