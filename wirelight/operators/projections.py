"""Projections between typed rows, wire entries and the unified event."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight import schemas


def entry_columns(kind: str, have: Iterable[str]) -> dict[str, Column]:
    """An entry's fields in terms of typed rows with the columns ``have``; what is not there is NULL.

    An ip row's byte count goes to bytesIn for incoming rows, else to bytesOut.
    """
    have = set(have)
    found = {f.name: (F.col(f.name) if f.name in have else F.lit(None)) for f in schemas.ENTRY[kind].fields}
    if kind == "ip" and "bytesCount" in have:
        incoming = F.coalesce(F.col("direction") == "in", F.lit(False))
        zero = F.lit(0).cast("bigint")
        found["bytesIn"] = F.when(incoming, F.col("bytesCount")).otherwise(zero)
        found["bytesOut"] = F.when(incoming, zero).otherwise(F.col("bytesCount"))
    return {f.name: found[f.name].cast(f.dataType) for f in schemas.ENTRY[kind].fields}


def _entry(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(*[column.alias(name) for name, column in entry_columns(kind, rows.columns).items()])


def to_dns_entry(rows: DataFrame) -> DataFrame:
    return _entry(rows, "dns")


def to_ip_entry(rows: DataFrame) -> DataFrame:
    return _entry(rows, "ip")


def to_http_entry(rows: DataFrame) -> DataFrame:
    return _entry(rows, "http")


def to_tls_entry(rows: DataFrame) -> DataFrame:
    return _entry(rows, "tls")


def with_direction(frames: DataFrame, mac: str) -> DataFrame:
    """``out`` for frames sent by the interface (MAC in hex), else ``in``."""
    own = mac.replace(":", "").replace("-", "").lower()
    sent = F.col("srcMac").eqNullSafe(F.lit(own))
    return frames.withColumn("direction", F.when(sent, "out").otherwise("in"))


def with_sensor_direction(frames: DataFrame, sensors: DataFrame) -> DataFrame:
    """Direction with one interface MAC per sensor (table: sensor, mac)."""
    macs = sensors.select("sensor", F.lower(F.regexp_replace("mac", "[:-]", "")).alias("_mac"))
    joined = frames.join(macs, "sensor", "left")
    sent = F.col("srcMac") == F.col("_mac")
    return joined.withColumn("direction", F.when(F.coalesce(sent, F.lit(False)), "out").otherwise("in")).drop("_mac")


def event_unified(tables: dict[str, DataFrame]) -> DataFrame:
    """Entries of several event types as one table over the unified schema."""
    merged = None
    for kind, df in sorted(tables.items()):
        tagged = df.withColumn("eventType", F.lit(kind))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no tables given")
    have = set(merged.columns)
    return merged.select("eventType", *[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.UNIFIED_EVENT.fields
    ])


def union_inputs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all inputs of one event type."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
