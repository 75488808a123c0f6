"""Batching and suppression of repeated DNS queries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUFFER_SIZE = 65_535
FLUSH_SECONDS = 30
LOOK_BACK = 8

# Rows counted together when numbering; bounds the largest sort of flush_batches.
_SLICE = 1 << 20


def flush_batches(
    rows: DataFrame, seq: str, by: list[str] | None = None,
    seconds: int = FLUSH_SECONDS, size: int = BUFFER_SIZE,
) -> DataFrame:
    """Add ``window_start`` and ``batch_no``: cuts by time, then by row count.

    ``seq`` is the unique arrival number.  Rows are numbered inside slices of the
    arrival order and the slices' counts are summed up, so no window, however
    full, is sorted as a whole.
    """
    by = by or []
    slot = F.window("ts", f"{seconds} seconds")["start"]
    cut = rows.withColumns({"window_start": slot, "_slice": F.floor(F.col(seq) / _SLICE)})
    group = [*by, "window_start"]
    in_slice = Window.partitionBy(*group, "_slice").orderBy(seq)
    counts = cut.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "_slice"]]
    numbered = cut.withColumn("_rn", F.row_number().over(in_slice)).alias("r").join(offsets.alias("o"), keys, "left")
    position = F.col("r._rn") + F.col("o._before") - 1
    return numbered.select(
        *[F.col(f"r.{c}") for c in [*rows.columns, "window_start"]],
        F.floor(position / size).cast("bigint").alias("batch_no"),
    )


def query_key(columns: list[str]) -> Column:
    """Text that is equal exactly when all columns are (NULL is its own value)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def keep_unlike_recent(seen: deque, keys) -> list[bool]:
    """Which keys differ from the last kept ones; ``seen`` is carried on."""
    kept = []
    for key in keys:
        fresh = key not in seen
        if fresh:
            seen.append(key)
        kept.append(fresh)
    return kept


def _suppress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    group, seen = None, deque(maxlen=LOOK_BACK)
    for batch in batches:
        keep: list[bool] = []
        for name, part in batch.groupby("_group", sort=False):
            if name != group:
                group, seen = name, deque(maxlen=LOOK_BACK)
            keep += keep_unlike_recent(seen, part["_key"])
        yield batch[keep]


def dedup_last8(rows: DataFrame, group: list[str], order: list[str], key: list[str]) -> DataFrame:
    """Drop rows equal (on ``key``) to one of the last eight kept rows of their group.

    Sequential inside a group (sensor and flush batch, see ``flush_batches``), so
    groups are sorted by Spark and then streamed through: a task holds eight keys
    and one Arrow batch, never a group.
    """
    tagged = rows.withColumns({"_group": query_key(group), "_key": query_key(key)})
    ordered = tagged.repartition("_group").sortWithinPartitions("_group", *order)
    return ordered.mapInPandas(_suppress, ordered.schema).drop("_group", "_key")


def dedup_horizon(
    rows: DataFrame, key: list[str], order: list[str], horizon: str = "30 seconds", before: DataFrame | None = None,
) -> DataFrame:
    """Drop rows that follow an equal row (on ``key``) within the horizon.

    The row before decides, kept or not, so a steady repetition stays silent.
    One hot key is cut into time slices first; each slice only needs the last
    timestamp of the slices before it.  ``before`` (key columns, ``_last``) has the
    newest times of rows that came earlier.
    """
    sliced = rows.withColumn("_slice", F.window("ts", "1 minute")["start"])
    within = Window.partitionBy(*key, "_slice").orderBy("ts", *order)
    ends = sliced.groupBy(*key, "_slice").agg(F.max("ts").alias("_last"))
    earlier = Window.partitionBy(*key).orderBy("_slice")
    ends = ends.select(*key, "_slice", F.lag("_last").over(earlier).alias("_prior"))
    if before is not None:
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
        ends = ends.alias("e").join(before.alias("b"), same, "left").select(
            *[F.col(f"e.{c}") for c in [*key, "_slice"]], F.col("e._prior").alias("_prior"), F.col("b._last").alias("_known"))
    else:
        ends = ends.withColumn("_known", F.lit(None).cast("timestamp"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*key, "_slice"]]
    joined = sliced.withColumn("_prev", F.lag("ts").over(within)).alias("r").join(ends.alias("e"), on, "left")
    # a remembered time after the row says nothing about what came before it
    known = F.when(F.col("e._known") <= F.col("r.ts"), F.col("e._known"))
    previous = F.greatest(F.coalesce(F.col("r._prev"), F.col("e._prior")), known)
    fresh = previous.isNull() | (F.col("r.ts") > previous + F.expr(f"INTERVAL {horizon}"))
    return joined.where(fresh).select(*[F.col(f"r.{c}") for c in rows.columns])
