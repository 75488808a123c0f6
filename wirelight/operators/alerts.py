"""Alert enrichment: threats, severity and scope groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.operators.lookup import fits_broadcast, lookup_join, materialise
from wirelight.operators.scope import groups_of_src
from wirelight.sources.scope_file import ScopeGroup

_UNKNOWN_SEVERITY = 0


def _threat(found: Column) -> Column:
    """Catalogue entry -> alert threat; an unknown id is a zero threat."""
    return F.struct(
        F.coalesce(found["severity"], F.lit(_UNKNOWN_SEVERITY)).alias("severity"),
        F.coalesce(found["title"], F.lit("")).alias("desc"),
        F.coalesce(found["policy"], F.lit(False)).alias("policy"),
    )


def threat_map(ids: Column, catalogue: Column) -> Column:
    """id -> {severity, desc, policy}, ordered by id, from a map column."""
    known = F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))
    return F.map_from_entries(F.transform(
        known, lambda t: F.struct(t.alias("id"), _threat(F.try_element_at(catalogue, t)).alias("threat"))
    ))


def max_severity(threats: Column) -> Column:
    """Highest severity in a threat map, at least 0."""
    levels = F.transform(F.map_values(threats), lambda t: t["severity"])
    return F.greatest(F.coalesce(F.array_max(levels), F.lit(0)), F.lit(0))


def alert_threats(alerts: DataFrame) -> DataFrame:
    """Replace threat ids by their entries from the alert's own page, add severity."""
    mapped = alerts.withColumn("threats", threat_map(F.col("threats"), F.col("catalogue")))
    return mapped.withColumn("severity", max_severity(F.col("threats"))).drop("catalogue")


def join_catalogue(alerts: DataFrame, alert_id: str, ids: str, catalogue: DataFrame) -> DataFrame:
    """Threat entries from a separate catalogue table: (alert_id, threats, severity).

    One row per alert.  The catalogue (id, title, severity, policy) is broadcast
    while it is small in bytes, else joined on distinct threat ids, however often
    each id occurs.  Of several entries of an id the greatest (by title, severity,
    policy) counts.
    """
    facts = catalogue.groupBy(F.col("id").alias("key")).agg(F.max(F.struct("title", "severity", "policy")).alias("facts"))
    facts = materialise(facts, "threats")
    exploded = alerts.select(alert_id, F.explode_outer(ids).alias("_threat"))
    if fits_broadcast(facts):
        small = F.broadcast(facts.select(F.col("key").alias("_id"), F.col("facts").alias("_facts")))
        found = exploded.join(small, F.col("_threat") == F.col("_id"), "left")
    else:
        found = lookup_join(exploded, "_threat", lambda keys: keys.join(facts, "key"), "_facts")
    entry = F.struct(F.col("_threat").alias("id"), _threat(F.col("_facts")).alias("threat"))
    # a set per alert: as many entries as the alert itself lists
    return found.groupBy(alert_id).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("_threat").isNotNull(), entry)))).alias("threats"),
        F.greatest(F.coalesce(F.max("_facts.severity"), F.lit(0)), F.lit(0)).alias("severity"),
    )


def enrich_alerts(alerts: DataFrame, groups: Sequence[ScopeGroup]) -> DataFrame:
    """Alert rows (see ``explode_pages``) -> flat alert events ready for the formatters."""
    none = F.array().cast("array<string>")
    flat = alert_threats(alerts).select(
        "eventType", "severity", "threats",
        F.coalesce("wisdom.flags", none).alias("flags"),
        F.coalesce("wisdom.labels", none).alias("labels"),
        "event.*",
    )
    return groups_of_src(flat, groups, "groups")
