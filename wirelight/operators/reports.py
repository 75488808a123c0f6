"""Counts over events and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_report(verdicts: DataFrame, kind: str = "event_type") -> DataFrame:
    """received, accepted and rejected (reason -> count) per event type.

    ``verdicts`` has keep and reason columns (scope operators with ``flag=True``).
    """
    # few reasons per type are left after the first, map-side combined, step
    by_reason = verdicts.groupBy(kind, "reason").agg(
        F.count("*").alias("n"), F.count_if("keep").alias("kept")
    )
    entry = F.when(F.col("n") > F.col("kept"), F.struct("reason", (F.col("n") - F.col("kept")).alias("n")))
    return by_reason.groupBy(kind).agg(
        F.sum("n").alias("received"), F.sum("kept").alias("accepted"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rejected"),
    )
