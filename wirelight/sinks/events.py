"""Event entries as newline-delimited JSON, dead letters, and writing to several sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelight import schemas
from wirelight.functions.times import wire_time
from wirelight.sinks.formats import format_alerts


def entry_json(kind: str, columns: Mapping[str, Column] | None = None) -> Column:
    """One entry as JSON text: blanks for absent values unless the field is optional.

    ``columns`` gives the fields where the row is no entry itself.
    """
    fields = []
    for f in schemas.ENTRY[kind].fields:
        value = columns[f.name] if columns else F.col(f.name)
        if f.dataType.typeName() == "timestamp":
            value = wire_time(value)
        elif f.dataType.typeName() == "string":
            value = F.nullif(value, F.lit("")) if f.name in schemas.OPTIONAL[kind] else F.coalesce(value, F.lit(""))
        elif f.name in schemas.OPTIONAL[kind]:
            value = F.nullif(value, F.lit(0).cast(f.dataType))
        else:
            value = F.coalesce(value, F.lit(0).cast(f.dataType))
        fields.append(value.alias(f.name))
    return F.to_json(F.struct(*fields))


def events_ndjson(entries: DataFrame, kind: str) -> DataFrame:
    return entries.select(entry_json(kind).alias("value"))


def write_events(tables: Mapping[str, DataFrame], path: str, mode: str = "append") -> None:
    """One folder of JSON lines per event type."""
    for kind, entries in sorted(tables.items()):
        events_ndjson(entries, kind).write.mode(mode).text(f"{path}/event_type={kind}")


def write_alerts(alerts: DataFrame, sinks: Mapping[str, str], batch_id: int, compression: str = "none") -> None:
    """Every alert to every sink ({format: folder}); a repeated batch replaces itself.

    Alert lines are long and much alike: with ``compression="gzip"`` the files take
    about a tenth of the disk, and Spark reads them back the same.
    """
    # worked out once for several sinks; a single one takes the rows as they come
    kept = alerts.persist() if len(sinks) > 1 else alerts
    try:
        for name, path in sorted(sinks.items()):
            format_alerts(kept, name).write.mode("overwrite").option("compression", compression).text(f"{path}/batch_id={batch_id}")
    finally:
        if len(sinks) > 1:
            kept.unpersist()


def dead_letters(bad: DataFrame, event_type: str, day: Column | None = None) -> DataFrame:
    """Bad rows (see ``split_errors``) with the columns the store is laid out by."""
    return bad.select(
        "_raw", "_error", "source_file", F.lit(event_type).alias("event_type"),
        (F.current_date() if day is None else day).alias("day"),
    )


def write_dead_letters(letters: DataFrame, path: str, mode: str = "append") -> None:
    letters.write.mode(mode).partitionBy("event_type", "day").parquet(path)


def replay_dead_letters(spark: SparkSession, path: str, event_type: str) -> DataFrame:
    """Stored lines of one event type, in the shape the line formats take."""
    return spark.read.parquet(path).where(F.col("event_type") == event_type).select(
        F.col("_raw").alias("value"), "source_file"
    )
