"""Trusted-domain matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelight.functions.names import name_suffixes, pattern_name, trusted_by, valid_pattern
from wirelight.operators.lookup import broadcast_levels, fits_broadcast, level_join, lookup_join, materialise
from wirelight.operators.networks import LITERAL_LIMIT


def domain_table(patterns: DataFrame, pattern: str, *tags: str) -> DataFrame:
    """(name, below, tags...) of valid entries; ``below`` marks ``*.`` entries."""
    return patterns.where(valid_pattern(pattern)).select(
        pattern_name(pattern).alias("name"), F.col(pattern).startswith("*").alias("below"), *tags
    ).distinct()


def domain_entries(table: DataFrame, tag: str) -> DataFrame:
    """One row (level, entry, tags) per entry of a domain table, as a written table.

    The level is the number of labels of a ``*.`` entry, 0 for a whole name.
    """
    level = F.when(F.col("below"), F.size(F.split("name", r"\."))).otherwise(0)
    entries = table.groupBy(level.alias("level"), F.col("name").alias("entry")).agg(F.collect_set(tag).alias("tags"))
    return materialise(entries, "domains")


def name_tail(key: str):
    """What a name looks up at a level of ``domain_entries``."""
    return lambda level: F.substring_index(key, ".", -level) if level else F.col(key)


def domain_hits(names: DataFrame, table: DataFrame, tag: str) -> DataFrame:
    """(key, tag) for distinct lower-cased names (column ``key``) under a domain table."""
    longest = table.where("below").agg(F.max(F.size(F.split("name", r"\.")))).first()[0] or 0
    suffixes = F.transform(name_suffixes("key", longest), lambda s: F.struct(
        s.alias("name"), F.lit(True).alias("below")
    ))
    whole = F.array(F.struct(F.col("key").alias("name"), F.lit(False).alias("below")))
    exploded = names.where(F.col("key") != "").select(
        "key", F.inline(F.concat(whole, suffixes) if longest else whole)
    )
    if fits_broadcast(table):
        return exploded.join(F.broadcast(table), ["name", "below"]).select("key", tag).distinct()

    def entry(name: str, below: str):
        return F.concat(F.when(F.col(below), "*").otherwise("="), F.col(name))

    tagged = table.groupBy(entry("name", "below").alias("key")).agg(
        F.struct(F.collect_set(tag).alias("tags")).alias("facts")
    )
    asked = exploded.select("key", entry("name", "below").alias("entry"))
    hits = lookup_join(asked, "entry", lambda e: e.join(tagged, "key"), "_hit")
    return hits.select("key", F.explode("_hit.tags").alias(tag)).distinct()


def domain_join(
    events: DataFrame, name: str, patterns: DataFrame, pattern: str, tag: str, out: str
) -> DataFrame:
    """Add ``out``: sorted tags of all entries that cover the event's name."""
    table = domain_table(patterns, pattern, tag)
    entries = domain_entries(table, tag)
    levels = broadcast_levels(entries, F.lit(True))

    def facts(names: DataFrame) -> DataFrame:
        return domain_hits(names, table, tag).groupBy("key").agg(
            F.struct(F.array_sort(F.collect_set(tag)).alias("tags")).alias("facts")
        )

    keyed = events.withColumn("_name", F.lower(name))
    if levels is not None:
        small = entries.select("level", "entry", F.struct("tags").alias("facts"))
        found = level_join(keyed, small, levels[0], name_tail("_name"), "_facts")
    else:
        found = lookup_join(keyed, "_name", facts, "_facts")
    none = F.array().cast("array<string>")
    return found.select(*events.columns, F.coalesce("_facts.tags", none).alias(out))


def drop_trusted(events: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Events whose name no entry covers (anti join); short lists become literals."""
    short = patterns.where(valid_pattern(pattern)).select(pattern).distinct()
    rows = short.limit(LITERAL_LIMIT + 1).collect()
    if len(rows) <= LITERAL_LIMIT:
        return events.where(~trusted_by(name, [r[0] for r in rows]))
    tagged = domain_join(events, name, patterns.withColumn("_any", F.lit("x")), pattern, "_any", "_tags")
    return tagged.where(F.size("_tags") == 0).drop("_tags")
