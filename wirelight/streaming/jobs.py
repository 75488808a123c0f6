"""Continuous ingestion: logs, documents and alerts.

Progress lives in Spark checkpoints.  Files a batch writes are named by its
batch id and replaced when the batch runs again, so a failed or repeated batch
neither loses nor doubles events.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.query import StreamingQuery

from wirelight.operators.alerts import enrich_alerts
from wirelight.operators.dedup import FLUSH_SECONDS, dedup_horizon
from wirelight.operators.scope import scope_dns, scope_http, scope_ip
from wirelight.operators.special import drop_special
from wirelight.schemas import ENTRY
from wirelight.sinks.events import dead_letters, entry_json, events_ndjson, write_alerts, write_dead_letters
from wirelight.sources.alert_pages import explode_pages
from wirelight.sources.documents import LANDED, decode, search as search_documents
from wirelight.sources.lines import land_lines, split_errors, stream_lines
from wirelight.sources.registry import get_format, parse, to_entry
from wirelight.sources.scope_file import ScopeGroup
from wirelight.sources.search_config import Search
from wirelight.streaming.state import last_kept, sessions

FILES_PER_BATCH = 1000


def flush_trigger(once: bool = False, seconds: int = FLUSH_SECONDS) -> dict:
    """Trigger arguments: everything that is there and stop, or a batch every 30 s."""
    return {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}


def in_scope(rows: DataFrame, event_type: str, groups: Sequence[ScopeGroup]) -> DataFrame:
    """Rows of one event type that are to be monitored (shuffle-free form)."""
    if event_type == "dns":
        return scope_dns(rows, groups)
    if event_type == "http":
        return scope_http(rows, groups)
    if event_type == "ip":
        rows = drop_special(rows)
    return scope_ip(rows, groups)


def stateful_dedup(
    rows: DataFrame, group: str, order: list[str], key: list[str], out: str, checkpoint: str, once: bool = False,
) -> StreamingQuery:
    """``dedup_last8`` over a stream, the last eight kept keys of each group carried from batch to batch.

    Kept rows are appended to ``out`` as Parquet, each once.  The rows of a group
    are put in order batch by batch, so the order of a batch's files and splits
    plays no part; a row of an earlier time in a later batch is judged then, never
    dropped for being late.  A busy group is spread over the cluster.
    """
    return last_kept(rows, group, order, key, checkpoint, flush_trigger(once), lambda kept: kept.writeStream.format("parquet").option("path", out))


def horizon_dedup(
    rows: DataFrame, key: list[str], out: str, checkpoint: str, order: list[str] | None = None,
    horizon: str = "30 seconds", late: str = "1 hour", once: bool = False,
) -> StreamingQuery:
    """``dedup_horizon`` over a stream: drops rows that follow an equal row (on ``key``) within the horizon.

    Rows up to ``late`` behind the newest are judged by all rows that came before
    them, in whatever order they came.  Later ones can't be judged any more and are
    kept apart: ``out`` is Parquet partitioned by ``late``, and every row is in it
    once or follows an equal one.  Keys leave the state store by event-time timers.
    """
    found = sessions(rows, key, order or [], horizon, late)
    return found.writeStream.format("parquet").partitionBy("late").option("path", out).option(
        "checkpointLocation", checkpoint
    ).trigger(**flush_trigger(once)).start()


def tail_to_events(
    spark: SparkSession,
    landing: str,
    log_format: str,
    event_type: str,
    groups: Sequence[ScopeGroup],
    out: str,
    checkpoint: str,
    dead_letter_path: str | None = None,
    once: bool = False,
    horizon: str = "30 seconds",
    repeats: str = "batch",
    late: str = "1 hour",
) -> StreamingQuery:
    """Log files landing in a folder -> scoped, de-duplicated entries as JSON lines.

    ``repeats`` says which DNS queries are suppressed. ``batch``: those that follow
    an equal one within the horizon and in the same micro-batch, which is the flush
    buffer. ``horizon``: the same across micro-batches, by state; rows more than
    ``late`` behind are sent. ``last8``: those equal to one of the last eight sent
    of their folder, by state. The latter two take formats read line by line,
    without dead letters.  Formats read line by line whose rows need no such
    step run as one streaming plan.  Zeek lines need their file's header, so a
    batch's lines are written to a table that the next batch replaces.
    """
    fmt = get_format(log_format)
    if not fmt.text:
        raise ValueError(f"format {log_format!r} is not read line by line, so it can't be tailed")
    lines = stream_lines(spark, landing, None if fmt.stateless else FILES_PER_BATCH)
    if fmt.stateless and event_type != "dns" and dead_letter_path is None and repeats == "batch":
        rows = in_scope(parse(lines, log_format, event_type, on_error="skip"), event_type, groups)
        text = to_entry(rows, event_type).select(entry_json(event_type).alias("value"))
        return text.writeStream.format("text").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(**flush_trigger(once)).start()

    if repeats != "batch":
        if repeats not in ("horizon", "last8") or not fmt.stateless or event_type != "dns" or dead_letter_path is not None:
            raise ValueError(f"repeats={repeats!r} takes DNS queries of formats read line by line, without dead letters")
        rows, asked = in_scope(parse(lines, log_format, "dns", on_error="skip"), "dns", groups), ["srcIP", "qtype", "query"]

        def as_text(kept: DataFrame) -> DataStreamWriter:
            return to_entry(kept, "dns").select(entry_json("dns").alias("value")).writeStream.format("text").option("path", out)

        if repeats == "last8":
            of_folder = rows.withColumn("_folder", F.regexp_extract("source_file", "^(.*)/", 1))
            return last_kept(of_folder, "_folder", ["ts", "source_file"], asked, checkpoint, flush_trigger(once), as_text)
        return as_text(sessions(rows, asked, [], horizon, late)).option(
            "checkpointLocation", checkpoint
        ).trigger(**flush_trigger(once)).start()

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch is whole files; where lines depend on earlier ones it is written down once
        rows = batch if fmt.stateless else land_lines(batch, f"{checkpoint}/lines")
        parsed = parse(rows, log_format, event_type, on_error="keep")
        good, bad = split_errors(parsed)
        kept = in_scope(good, event_type, groups)
        if event_type == "dns":
            kept = dedup_horizon(kept, ["srcIP", "qtype", "query"], [], horizon)
        publish(to_entry(kept, event_type), event_type, out, batch_id)
        if dead_letter_path is not None:
            letters = dead_letters(bad, event_type)
            write_dead_letters(letters, f"{dead_letter_path}/batch_id={batch_id}", mode="overwrite")

    return lines.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(**flush_trigger(once)).start()


def publish(entries: DataFrame, event_type: str, out: str, batch_id: int) -> None:
    """Write a batch of entries; running the same batch again replaces its files."""
    events_ndjson(entries, event_type).write.mode("overwrite").text(f"{out}/batch_id={batch_id}")


def publish_stream(
    entries: DataFrame, event_type: str, out: str, checkpoint: str, once: bool = False,
    write: Callable[[DataFrame, str, str, int], None] = publish,
) -> StreamingQuery:
    """Entries to JSON lines, batch by batch; a batch whose write fails is run again."""
    return entries.writeStream.foreachBatch(
        lambda batch, batch_id: write(batch, event_type, out, batch_id)
    ).option("checkpointLocation", checkpoint).trigger(**flush_trigger(once)).start()


def follow_alerts(
    pages: DataFrame, groups: Sequence[ScopeGroup], sinks: Mapping[str, str], checkpoint: str, once: bool = False,
    compression: str = "none",
) -> StreamingQuery:
    """Alert pages as they land -> enriched alert lines in every sink (``compression`` see ``write_alerts``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_alerts(enrich_alerts(explode_pages(batch), groups), sinks, batch_id, compression)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **flush_trigger(once)
    ).start()


def started_at(spark: SparkSession, checkpoint: str, since: datetime) -> datetime:
    """The time a stream of documents began to look from: ``since`` at its first start, the same ever after."""
    place = f"{checkpoint}/since"
    try:
        micros = spark.read.parquet(place).agg(F.unix_micros(F.min("since"))).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        since = since if since.tzinfo else since.replace(tzinfo=timezone.utc)
        spark.createDataFrame([(since,)], "since timestamp").write.mode("overwrite").parquet(place)
        return since
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def stream_documents(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """Landed documents (Parquet) as files arrive in a folder."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).parquet(path)


def follow_documents(
    docs: DataFrame,
    search: Search,
    groups: Sequence[ScopeGroup],
    out: str,
    checkpoint: str,
    now: datetime | None = None,
    max_age: str = "24 hours",
    once: bool = False,
    write: Callable[[DataFrame, str, str, int], None] = publish,
) -> StreamingQuery:
    """A stream of landed documents -> scoped entries as JSON lines, every document once.

    Progress is the files that are done, in the checkpoint, not a time: a document
    that lands late with a time already seen is new all the same, and a batch whose
    write failed is run again whole. Fetching jobs may land a document twice; one id
    with one ingested time counts once within ``max_age``, and documents further
    behind the newest are left out. Documents up to five minutes older than the
    first start are looked at.
    """
    now = now or datetime.now(timezone.utc)
    since = started_at(docs.sparkSession, checkpoint, now - timedelta(minutes=5))
    found = decode(search_documents(docs, search, F.lit(since)), search)
    kept = in_scope(found, search.event_type, groups).withWatermark("ingested", max_age).dropDuplicatesWithinWatermark(["id", "ingested"])
    return publish_stream(kept.select(*ENTRY[search.event_type].names), search.event_type, out, checkpoint, once, write)
