"""Suppression of repeats that is carried over micro-batches.

For the horizon it is keyed state of Spark's state store: a batch reads and writes
the state of the keys it holds and of those whose timer is due, nothing else, and
takes its rows as they come.

For the last kept keys a group is one chain, and a batch may be one group's rows. A
batch is cut into slices that run side by side (``operators/busy_groups.py``), from
the last kept keys of all groups, a small table that each batch writes anew beside
the checkpoint. What it keeps is written once and passed on by a stream of its own,
so a sink has each row once, however often a batch is run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wirelight.operators.busy_groups import last8_from
from wirelight.operators.dedup import query_key
from wirelight.session import delete_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT = "HDFSBackedStateStoreProvider"
_LAST = "_group string, _ends array<string>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs RocksDB; its changes alone are written per batch. A provider of the user's own choice stays."""
    if spark.conf.get(_PROVIDER, _DEFAULT).endswith(_DEFAULT):
        spark.conf.set(_PROVIDER, _ROCKS)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _place(row: Row) -> tuple:
    """The values of ``_order`` (a struct, which comes as a dict), NULL first."""
    return tuple((x is not None, x) for x in row["_order"].values())


class Sessions(StatefulProcessor):
    """Passes rows that follow no equal row within the horizon, and rows that come too late, marked.

    The state of a key is its runs of rows no further apart than the horizon, as
    (first, last) microseconds. A batch's rows come in any order and are not
    held: of each run they form among themselves the first row is remembered, the
    only one that may be new. Event-time timers drop what the watermark and the
    horizon have passed, whether or not the key has new rows.
    """

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "first array<bigint>, last array<bigint>, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.runs.get()
        first, last, timer = (list(known[0]), list(known[1]), known[2]) if known else ([], [], None)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        begun, ended, heads = [], [], []
        for row in rows:
            at = row["_at"]
            if at < passed:
                yield Row(_row=row["_row"], late=True)
                continue
            i, n = self._touched(begun, ended, at, at)
            if not n:
                begun.insert(i, at)
                ended.insert(i, at)
                heads.insert(i, row)
                continue
            # of the rows that touch, the first in order stands for the run
            if at < begun[i] or at == begun[i] and _place(row) < _place(heads[i]):
                heads[i] = row
            begun[i : i + n] = [min(begun[i], at)]
            ended[i : i + n] = [max(ended[i + n - 1], at)]
            del heads[i + 1 : i + n]
        for start, end, row in zip(begun, ended, heads, strict=True):
            i = bisect_right(first, start) - 1
            if i < 0 or start > last[i] + self.horizon:
                yield Row(_row=row["_row"], late=False)
            i, n = self._touched(first, last, start, end)
            low, high = (min(first[i], start), max(last[i + n - 1], end)) if n else (start, end)
            first[i : i + n], last[i : i + n] = [low], [high]
        self._keep(first, last, timer, passed)

    def _touched(self, first: list[int], last: list[int], start: int, end: int) -> tuple[int, int]:
        """Place and number of the runs no further than the horizon from start..end; runs are in order and lie further apart."""
        stop = bisect_right(first, end + self.horizon)
        at = stop
        while at and last[at - 1] + self.horizon >= start:
            at -= 1
        return at, stop - at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.runs.get()
        if known:
            self._keep(list(known[0]), list(known[1]), None, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def _keep(self, first: list[int], last: list[int], timer: int | None, passed: int) -> None:
        alive = [i for i, end in enumerate(last) if end + self.horizon >= passed]
        if not alive:
            self.runs.clear()
            return
        if timer is None:
            # the next look at this key; one timer is out at a time
            timer = (last[alive[0]] + self.horizon) // 1000 + 1
            self.handle.registerTimer(timer)
        self.runs.update(([first[i] for i in alive], [last[i] for i in alive], timer))

    def close(self) -> None:
        pass


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def keep_batch(batch: DataFrame, batch_id: int, folder: str, group: str, order: list[str], key: list[str]) -> None:
    """Writes a batch's rows unlike the last eight kept ones of their group, and the last keys of all groups.

    A batch that is run again after it was written is left as it is.
    """
    spark = batch.sparkSession
    if _there(spark, f"{folder}/done/{batch_id}"):
        return
    before = spark.read.schema(_LAST).parquet(f"{folder}/last/{batch_id - 1}") if batch_id else None
    kept, last = last8_from(batch, [group], order, key, before)
    kept.write.mode("overwrite").parquet(f"{folder}/kept/{batch_id}")
    last.write.mode("overwrite").parquet(f"{folder}/last/{batch_id}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/{batch_id}")


def last_kept(
    rows: DataFrame, group: str, order: list[str], key: list[str], checkpoint: str, trigger: dict, write: Callable[[DataFrame], DataStreamWriter],
) -> StreamingQuery:
    """A stream's rows unlike (on ``key``) the last eight kept ones of their group, as a stream into ``write``'s sink.

    NULL is a group, and a key value, of its own.
    """
    spark, folder, schema = rows.sparkSession, f"{checkpoint}/kept_keys", rows.schema

    def judge(batch: DataFrame, batch_id: int) -> None:
        keep_batch(batch, batch_id, folder, group, order, key)
        # the files a sink has taken are in its own checkpoint
        found = spark.readStream.schema(schema).parquet(f"{folder}/kept/*")
        write(found).option("checkpointLocation", f"{folder}/sink").trigger(availableNow=True).start().awaitTermination()
        for old in (f"kept/{batch_id - 1}", f"last/{batch_id - 2}", f"done/{batch_id - 2}"):
            delete_folder(spark, f"{folder}/{old}")

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sessions(rows: DataFrame, key: list[str], order: list[str], horizon: str, late: str) -> DataFrame:
    """A stream's rows that follow no equal row (on ``key``) within the horizon, and a column ``late``.

    A row more than ``late`` behind the newest row of the batches before is passed
    on with ``late`` true and plays no other part. Rows without a time have no
    place in the order of events and come as late, too.
    """
    use_state_store(rows.sparkSession)
    start = "TIMESTAMP '1970-01-01 00:00:00Z'"
    micros = rows.sparkSession.sql(f"SELECT unix_micros({start} + INTERVAL {horizon}) - unix_micros({start})").first()[0]
    # the column that carries the watermark ends here: rows behind it must reach the state
    clocked = rows.withColumn("_clock", F.col("ts").cast("timestamp")).withWatermark("_clock", late)
    tagged = clocked.select(
        query_key(key).alias("_key"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))).alias("_at"),
        F.struct("ts", *order).alias("_order"), F.struct(*rows.columns).alias("_row"))
    out = T.StructType([tagged.schema["_row"], T.StructField("late", T.BooleanType())])
    return tagged.groupBy("_key").transformWithState(Sessions(micros), out, "append", "EventTime").select("_row.*", "late")
