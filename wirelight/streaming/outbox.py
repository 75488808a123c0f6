"""Delivery to sinks that can fail for good: what isn't sent is kept and sent again.

A batch is sent under its stream's name and its number. A sink that takes the same
pair as a replacement, not as more events, gets each event once, whatever breaks.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wirelight.session import delete_folder
from wirelight.streaming.jobs import flush_trigger

TRIES = 5

Send = Callable[[DataFrame, str, str, int], None]
"""Takes entries, their event type, the stream's name and the batch's number."""


def _place(outbox: str, event_type: str, stream: str, batch_id: int) -> str:
    return f"{outbox}/event_type={event_type}/stream={stream}/batch_id={batch_id}"


def _attempt(send: Send, entries: DataFrame, event_type: str, stream: str, batch_id: int, tries: int, wait: float) -> str | None:
    """Sends, again if that fails, twice as long after each try; the last error's text if all fail."""
    error = None
    for attempt in range(tries):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            send(entries, event_type, stream, batch_id)
            return None
        except Exception as problem:  # noqa: BLE001  whatever a sink raises, its events are kept
            error = f"{type(problem).__name__}: {problem}"
    return error


def deliver_stream(
    entries: DataFrame, event_type: str, send: Send, outbox: str, checkpoint: str, stream: str = "main",
    tries: int = TRIES, wait: float = 1.0, once: bool = False,
) -> StreamingQuery:
    """Sends a stream's entries batch by batch; a batch that can't be sent goes to the outbox and the stream goes on.

    The outbox is Parquet, one folder per event type, stream and batch, with the
    last error in ``_error``. A batch that runs again after a crash replaces its
    folder, or removes it if it is sent this time, so an event is either sent or in
    the outbox once the batch is done.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        error = _attempt(send, batch, event_type, stream, batch_id, tries, wait)
        place = _place(outbox, event_type, stream, batch_id)
        if error is None:
            delete_folder(batch.sparkSession, place)
        else:
            batch.withColumn("_error", F.lit(error)).write.mode("overwrite").parquet(place)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**flush_trigger(once)).start()


def unsent(spark: SparkSession, outbox: str, event_type: str) -> DataFrame | None:
    """The outbox's events of one type as a table, with stream, batch_id and _error; None where nothing waits."""
    try:
        return spark.read.option("basePath", f"{outbox}/event_type={event_type}").option("mergeSchema", "true").parquet(f"{outbox}/event_type={event_type}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def replay_unsent(spark: SparkSession, outbox: str, event_type: str, send: Send, tries: int = TRIES, wait: float = 1.0) -> tuple[int, int]:
    """Sends what waits, oldest batches first, under the batches' own numbers; (batches sent, batches still waiting).

    A batch leaves the outbox only after it is sent. If the job dies between the
    two, the batch is sent again under the same number.
    """
    waiting = unsent(spark, outbox, event_type)
    if waiting is None:
        return 0, 0
    done = left = 0
    # one small row per batch
    for row in waiting.select("stream", "batch_id").distinct().orderBy("batch_id", "stream").toLocalIterator():
        stream, place = str(row["stream"]), _place(outbox, event_type, str(row["stream"]), row["batch_id"])
        if _attempt(send, spark.read.parquet(place).drop("_error"), event_type, stream, row["batch_id"], tries, wait) is None:
            delete_folder(spark, place)
            done += 1
        else:
            left += 1
    return done, left
