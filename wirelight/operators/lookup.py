"""Left join of a large event table with facts about one of its key columns.

``level_join`` is for facts of a proven size: they are broadcast, the events are
read once, in place and only in the columns that are wanted.

``lookup_join`` is for facts of any size.  One key may hold a third of all rows.
The facts are worked out once per distinct key (partial aggregation removes the
repeats before any shuffle).  The hottest keys, a fixed number of them, are joined
by broadcast; only the rest is shuffled, and no key of that rest can hold more
than one part in ``HOT_KEYS`` of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.session import work_dir

HOT_KEYS = 1024
_SPREAD = 4096

# Facts of at most this many bytes, written out as text, are broadcast.
BROADCAST_BYTES = 16 << 20
MOST_LEVELS = 40


def text_bytes(df: DataFrame) -> Column:
    """Aggregate: the size of a table's rows, written out as text."""
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))


def fits_broadcast(df: DataFrame) -> bool:
    return df.agg(text_bytes(df)).first()[0] <= BROADCAST_BYTES


def broadcast_levels(entries: DataFrame, *wanted: Column) -> list[list[int]] | None:
    """Per condition the levels of its entries; None when the table is too large for ``level_join``."""
    levels = [F.collect_set(F.when(condition, F.col("level"))) for condition in wanted]
    size, *found = entries.agg(text_bytes(entries), *levels).first()
    fits = size <= BROADCAST_BYTES and all(len(f) <= MOST_LEVELS for f in found)
    return [sorted(f) for f in found] if fits else None


def level_join(
    rows: DataFrame, entries: DataFrame, levels: list[int], probe: Callable[[int], Column], out: str
) -> DataFrame:
    """Add struct column ``out``: the facts of all entries that cover a row, merged.

    ``entries`` has one row (level, entry, facts) per entry, ``facts`` being a
    struct of arrays; ``probe`` gives what a row looks up at a level.  A broadcast
    join per level: no shuffle, and a row never becomes several.
    """
    before, found = rows.columns, []
    for level in levels:
        side = entries.where(F.col("level") == level).select(
            F.col("entry").alias("_entry"), F.col("facts").alias(f"_level_{level}")
        )
        rows = rows.join(F.broadcast(side), probe(level) == F.col("_entry"), "left").drop("_entry")
        found.append(f"_level_{level}")

    def merged(field: T.StructField) -> Column:
        none = F.array().cast(field.dataType)
        lists = [F.coalesce(F.col(f)[field.name], none) for f in found]
        return (F.array_sort(F.array_distinct(F.concat(*lists))) if lists else none).alias(field.name)

    fields = entries.schema["facts"].dataType.fields
    return rows.select(*before, F.struct(*[merged(f) for f in fields]).alias(out))


def _row_spread() -> Column:
    """A number per row, to scatter rows that need no join, equal ones too."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared working folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    planner the table's true size to pick join strategies by.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    events: DataFrame,
    key: str,
    facts: Callable[[DataFrame], DataFrame],
    out: str,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Add struct column ``out`` with the facts of ``key`` (NULL: no facts).

    ``facts`` maps a table of distinct keys (columns ``key`` and ``rows``) to one
    row per key that has facts: ``key`` and a struct column ``facts``.
    ``keys_from`` is a cheaper table with the same keys to count them in.
    """
    source = events if keys_from is None else keys_from
    keys = source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count("*").alias("rows")
    )
    keys = materialise(keys, "keys")
    known = materialise(keys.join(facts(keys).select("key", "facts"), "key", "left"), "facts")
    hot = known.orderBy(F.desc("rows"), "key").limit(HOT_KEYS)
    hot = F.broadcast(hot.select(F.col("key").alias("_hot"), F.col("facts").alias("_hot_facts")))
    cold = known.where(F.col("facts").isNotNull())
    cold = cold.select(F.col("key").alias("_cold"), F.col("facts").alias("_cold_facts"))

    marked = events.join(hot, F.col(key) == F.col("_hot"), "left")
    # rows already answered keep a scattered key that meets nothing
    spread = F.concat(F.lit("~"), _row_spread().cast("string"))
    needs_join = F.col("_hot").isNull() & F.col(key).isNotNull()
    marked = marked.withColumn("_at", F.when(needs_join, F.col(key)).otherwise(spread))
    joined = marked.join(cold, F.col("_at") == F.col("_cold"), "left")
    return joined.withColumn(out, F.coalesce("_hot_facts", "_cold_facts")).select(
        *events.columns, out
    )
