"""Streaming jobs run to the end over data derived from the tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight.operators.projections import to_dns_entry
from wirelight.plans.alert_queries import _LINES, _pages
from wirelight.plans.document_queries import dns_documents
from wirelight.plans.log_queries import _zeek_conn_lines, broken_eve_lines, eve_dns_lines
from wirelight.plans.registry import query
from wirelight.plans.scope_queries import _SCOPE_IP, GROUPS, _multi
from wirelight.plans.views import CHATTER, DNS, view_sql
from wirelight.session import work_dir
from wirelight.sinks.events import dead_letters, events_ndjson, replay_dead_letters, write_dead_letters
from wirelight.sources import registry
from wirelight.sources.alert_pages import stream_pages
from wirelight.sources.lines import split_errors
from wirelight.sources.scope_file import load_scope
from wirelight.sources.search_config import Search
from wirelight.streaming.jobs import (
    follow_alerts, follow_documents, horizon_dedup, publish_stream, stateful_dedup, stream_documents, tail_to_events,
)
from wirelight.streaming.outbox import deliver_stream, replay_unsent, unsent


def _stream(spark: SparkSession, sf: str, columns: dict[str, str]) -> DataFrame:
    """A view over the events table as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def _landed(lines: DataFrame, name: str, compression: str = "none") -> str:
    path = work_dir(lines.sparkSession, name)
    # a compressed file can't be split, so it holds no more lines than a task should read; there are as many files as it takes
    lines.select("value").write.option("compression", compression).option("maxRecordsPerFile", 0 if compression == "none" else 100_000).text(path)
    return path


_KEPT_DNS = f"(SELECT *, {_multi('dns')} FROM {view_sql('dns')} WHERE event_id % 4 <> 3)"
_FRACTION = "CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END"
_ENTRY_JSON = f"""concat('{{"ts":"', strftime(ts, '%Y-%m-%dT%H:%M:%S'), {_FRACTION}, 'Z","srcIP":"', "srcIP", '","query":"', "query", '","qtype":"', qtype, '"}}')"""


@query("t01_tail_to_events", f"SELECT {_ENTRY_JSON} AS value FROM {_KEPT_DNS} WHERE keep")
def tailed(spark: SparkSession, sf: str) -> DataFrame:
    """EVE files landing in a folder -> scoped DNS entries (repeats within 1 ms suppressed)."""
    out = work_dir(spark, "tail")
    tail_to_events(spark, _landed(eve_dns_lines(spark, sf), "landing"), "suricata", "dns", GROUPS, f"{out}/data", f"{out}/checkpoint",
                   once=True, horizon="1 millisecond").awaitTermination()
    return spark.read.text(f"{out}/data").select("value")


@query("s18_tail_stream", f"SELECT \"srcIP\", count(*) AS entries, CAST(sum(\"bytesCount\") AS BIGINT) AS bytes FROM (SELECT *, {_SCOPE_IP} FROM {view_sql('conn')}) WHERE keep GROUP BY \"srcIP\"")
def tailed_zeek(spark: SparkSession, sf: str) -> DataFrame:
    """Zeek files of all sensors, with headers, read batch by batch; entries per source."""
    landing, out = work_dir(spark, "zeek"), work_dir(spark, "zeek-out")
    lines = _zeek_conn_lines(spark, sf)
    # a sensor's lines stay in order and together in its folder's file
    lines.repartition("source_file").sortWithinPartitions("source_file", "line_no").select("value", "source_file").write.partitionBy(
        "source_file").text(landing)
    tail_to_events(spark, landing, "bro", "ip", load_scope(), f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    entries = spark.read.text(f"{out}/data").select(
        F.get_json_object("value", "$.srcIP").alias("srcIP"), F.get_json_object("value", "$.bytesOut").cast("bigint").alias("bytesOut"))
    return entries.groupBy("srcIP").agg(F.count("*").alias("entries"), F.sum("bytesOut").alias("bytes"))


@query("t02_periodic_flush", f"SELECT count(*) AS entries FROM {view_sql('dns')}")
def flushed(spark: SparkSession, sf: str) -> DataFrame:
    """DNS entries published batch by batch."""
    out = work_dir(spark, "flush")
    entries = to_dns_entry(_stream(spark, sf, DNS))
    publish_stream(entries, "dns", f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.text(f"{out}/data").agg(F.count("*").alias("entries"))


_AT = "TIMESTAMP '2024-01-20 00:00:00'"


@query("t03_incremental_docs", f"""SELECT {_ENTRY_JSON} AS value, CASE WHEN ts <= {_AT} THEN 1 ELSE 2 END AS poll FROM (SELECT *, {_multi('dns')} FROM {view_sql('dns')}
 WHERE event_id % 7 <> 6 AND ts > {_AT} - INTERVAL 5 MINUTE) WHERE keep""")
def polled(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over a folder: documents of the first days, then the rest and once more those of the last hour before."""
    out, docs = work_dir(spark, "polls"), dns_documents(spark, sf)
    now = datetime(2024, 1, 20, tzinfo=timezone.utc)

    def run(landed: DataFrame) -> int:
        landed.write.mode("append").parquet(f"{out}/landed")
        found = follow_documents(stream_documents(spark, f"{out}/landed"), Search("dns", "ecs"), GROUPS, f"{out}/entries", f"{out}/checkpoint", now, max_age="100 days", once=True)
        found.awaitTermination()
        return max((p["batchId"] for p in found.recentProgress), default=-1)

    first = run(docs.where(f"ingested <= {_AT}"))
    run(docs.where(f"ingested > {_AT} - INTERVAL 1 HOUR"))
    return spark.read.text(f"{out}/entries").select("value", F.when(F.col("batch_id") <= first, 1).otherwise(2).alias("poll"))


@query("t04_stateful_dedup", f"""SELECT CAST(split_part(kept, '|', 2) AS BIGINT) AS event_id FROM (SELECT unnest(list_reduce(rows, lambda a, b:
 CASE WHEN list_contains(list_transform(a[-8:], lambda e: split_part(e, '|', 1)), split_part(b[1], '|', 1)) THEN a ELSE list_concat(a, b) END)) AS kept
 FROM (SELECT list([concat("srcIP", '/', qtype, '/', "query", '|', CAST(event_id AS VARCHAR))] ORDER BY event_id) AS rows FROM {view_sql('chatter')} GROUP BY sensor))""")
def remembered(spark: SparkSession, sf: str) -> DataFrame:
    """The last eight kept questions of each sensor as streaming state."""
    out = work_dir(spark, "stateful")
    stateful_dedup(_stream(spark, sf, CHATTER), "sensor", ["event_id"], ["srcIP", "destIP", "qtype", "query"],
                   f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id")


@query("t04_horizon_dedup", f"SELECT DISTINCT \"srcIP\", qtype, \"query\" FROM {view_sql('chatter')}")
def remembered_longer(spark: SparkSession, sf: str) -> DataFrame:
    """First question of each key within a horizon longer than the data."""
    out, rows = work_dir(spark, "horizon"), _stream(spark, sf, CHATTER)
    horizon_dedup(rows, ["srcIP", "qtype", "query"], f"{out}/data", f"{out}/checkpoint", ["event_id"], "100 days", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/data").where("NOT late").select("srcIP", "qtype", "query")


@query("t05_alert_follow", f"SELECT count(*) AS lines, count(DISTINCT id) AS threats FROM {_LINES}")
def followed(spark: SparkSession, sf: str) -> DataFrame:
    """Alert pages landing in a folder -> CEF lines."""
    out = work_dir(spark, "follow")
    follow_alerts(stream_pages(spark, _landed(_pages(spark, sf), "pages", "gzip")), GROUPS, {"cef": f"{out}/cef"}, f"{out}/checkpoint", once=True,
                  compression="gzip").awaitTermination()
    lines = spark.read.text(f"{out}/cef").select(F.split("value", r"(?<!\\)\|")[4].alias("id"))
    return lines.agg(F.count("*").alias("lines"), F.countDistinct("id").alias("threats"))


@query("t06_requeue_failed", f"SELECT {_ENTRY_JSON} AS value FROM {view_sql('dns')}")
def requeued(spark: SparkSession, sf: str) -> DataFrame:
    """A batch whose first write breaks off half-way is written again, whole and once."""
    from wirelight.streaming.jobs import publish

    out, tries = work_dir(spark, "requeue"), []

    def unreliable(entries: DataFrame, event_type: str, path: str, batch_id: int) -> None:
        tries.append(batch_id)
        if len(tries) == 1:
            publish(entries.where("query LIKE 'e%'"), event_type, path, batch_id)
            raise OSError("connection lost")
        publish(entries, event_type, path, batch_id)

    for attempt in (1, 2):
        run = publish_stream(to_dns_entry(_stream(spark, sf, DNS)), "dns", f"{out}/data", f"{out}/checkpoint", once=True, write=unreliable)
        try:
            run.awaitTermination()
        except Exception:
            if attempt == 2:
                raise
    return spark.read.text(f"{out}/data").select("value")


@query("t07_dead_letter", f"SELECT sensor AS source_file, count(*) AS letters FROM {view_sql('dns')} WHERE (1024 + event_id % 60000) % 10 = 0 GROUP BY sensor")
def buried(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that cannot be read, stored and taken up again."""
    path = work_dir(spark, "letters")
    _, bad = split_errors(registry.parse(broken_eve_lines(spark, sf), "suricata", "dns", on_error="keep"))
    write_dead_letters(dead_letters(bad, "dns", F.lit("2024-01-01").cast("date")), path)
    return replay_dead_letters(spark, path, "dns").groupBy("source_file").agg(F.count("*").alias("letters"))


@query("t07_unsent_events", f"""SELECT value, count(*) AS waited, count(*) AS delivered FROM (SELECT {_ENTRY_JSON} AS value FROM {view_sql('dns')}) GROUP BY value""")
def delivered_later(spark: SparkSession, sf: str) -> DataFrame:
    """A sink that is down takes nothing: every entry waits in the outbox, and each is delivered once when it is back."""
    out = work_dir(spark, "outbox")

    def down(entries: DataFrame, event_type: str, stream: str, batch_id: int) -> None:
        raise OSError("connection refused")

    def back(entries: DataFrame, event_type: str, stream: str, batch_id: int) -> None:
        events_ndjson(entries, event_type).write.mode("overwrite").text(f"{out}/sent/{stream}-{batch_id}")

    deliver_stream(to_dns_entry(_stream(spark, sf, DNS)), "dns", down, f"{out}/box", f"{out}/checkpoint", tries=2, wait=0.01, once=True).awaitTermination()
    waited = events_ndjson(unsent(spark, f"{out}/box", "dns"), "dns").groupBy("value").agg(F.count("*").alias("waited"))
    waited.write.parquet(f"{out}/waited")
    replay_unsent(spark, f"{out}/box", "dns", back)
    if unsent(spark, f"{out}/box", "dns") is not None:
        raise RuntimeError("entries still wait")
    sent = spark.read.text(f"{out}/sent/*").groupBy("value").agg(F.count("*").alias("delivered"))
    return spark.read.parquet(f"{out}/waited").join(sent, "value", "full")
