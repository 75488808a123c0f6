"""Facts of all networks that hold an address, for network tables of any size, with one shuffle of the events.

Networks contain one another or are apart, so they cut the addresses into
elementary intervals, each with the facts of its innermost network and of all
around it. Those are worked out once, on the network table. Events and the points
where intervals begin are then dealt by address range and put in order, and each
event takes the facts of the last point before it.

An address is its key text, a network a beginning of keys (``functions/ip.py``).
As text a beginning comes before all keys that have it, and before all longer
beginnings, so text order is address order, from the outer network to the inner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirelight.operators.lookup import materialise

# Characters of a key that an address range shares: 12 bits of an IPv4 key, 32 of an IPv6 key.
V4_RANGE, V6_RANGE = 4, 9

# No range is dealt out in parts of more than one in this many rows, so at most as many are divided.
PARTS = 1024
LEAST_PART = 100_000

_SPREAD = 4096


def _range(key: Column) -> Column:
    return F.when(key.startswith("4"), F.substring(key, 1, V4_RANGE)).otherwise(F.substring(key, 1, V6_RANGE))


def _after(prefix: Column) -> Column:
    """The beginning that follows: the last digit that is not F, one higher."""
    head = F.rtrim(prefix, F.lit("F"))
    digit = F.translate(F.right(head, F.lit(1)), "0123456789ABCDE", "123456789ABCDEF")
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), digit)


def _merged(facts: list[str], source: str) -> Column:
    """Aggregate: one struct of arrays from many, field by field."""
    return F.struct(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(source)[f])))).alias(f) for f in facts])


def elementary(entries: DataFrame) -> DataFrame:
    """(entry, end, facts, outer): a network's facts with those of all around it, and the facts in force behind its end.

    ``entries`` has one row (entry, facts) per network; ``outer`` is NULL where no
    network goes on behind the end.
    """
    fields = entries.schema["facts"].dataType.names
    # a key has 33 characters at most, so no more than 33 lengths come back
    lengths = sorted(r[0] for r in entries.select(F.length("entry")).distinct().collect())
    shorter = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n < F.length("entry"))
    around = entries.select("entry", F.explode(F.transform(shorter, lambda n: F.substring(F.col("entry"), F.lit(1), n))).alias("_outer"))
    known = entries.select(F.col("entry").alias("_outer"), F.col("facts").alias("_facts"))
    held = around.join(known, "_outer").select("entry", "_outer", "_facts")
    every = held.unionByName(entries.select("entry", F.col("entry").alias("_outer"), F.col("facts").alias("_facts")))
    own = every.groupBy("entry").agg(
        _merged(fields, "_facts").alias("facts"),
        F.max(F.when(_after(F.col("_outer")) != _after(F.col("entry")), F.col("_outer"))).alias("_next"))
    own = materialise(own, "elementary")
    outer = own.select(F.col("entry").alias("_next"), F.col("facts").alias("outer"))
    return own.join(outer, "_next", "left").select("entry", _after(F.col("entry")).alias("end"), "facts", "outer")


def range_counts(rows: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Per key column its ranges and their rows, (_range, _n), all counted in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), _range(F.col(k)).alias("range")) for k in keys])).alias("_of")
    found = rows.select(each).where("_of.range IS NOT NULL").groupBy(F.col("_of.key").alias("_key"), F.col("_of.range").alias("_range")).agg(F.count("*").alias("_n"))
    found = materialise(found, "ranges")
    return {k: found.where(F.col("_key") == k).select("_range", "_n") for k in keys}


def interval_join(rows: DataFrame, key: str, entries: DataFrame, out: str, counts: DataFrame | None = None) -> DataFrame:
    """Add struct column ``out``: the facts of all entries that cover a row's key, merged; NULL where there are none.

    ``entries`` is as for ``level_join``: one row (level, entry, facts) per entry,
    ``facts`` being a struct of arrays. One address, or one range, may hold most
    rows: its rows are dealt out in parts, and the points of its range go to each.
    ``counts`` are the rows by range where they are known (``range_counts``).
    """
    parts = materialise(elementary(entries.select("entry", "facts")), "intervals")
    if counts is None:
        counts = range_counts(rows, [key])[key]
    total = counts.agg(F.sum("_n")).first()[0] or 0
    part = max(LEAST_PART, total // PARTS)
    # at most PARTS rows, whatever the events
    divided = counts.where(F.col("_n") > part).select(F.col("_range").alias("_hot"), F.ceil(F.col("_n") / part).cast("int").alias("_parts"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(divided), F.col("_range") == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")

    inside = F.length("entry") > F.when(F.col("entry").startswith("4"), V4_RANGE).otherwise(V6_RANGE)
    small = parts.where(inside).withColumn("_range", _range(F.col("entry")))
    begins = small.select("_range", F.col("entry").alias("_at"), F.lit(1).alias("_kind"), F.col("facts").alias("_found"))
    ends = small.where(_range(F.col("end")) == F.col("_range")).select("_range", F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.col("outer").alias("_found"))
    # where a network begins at another's end, its beginning counts
    points = begins.unionByName(ends).groupBy("_range", "_at").agg(F.max_by(F.struct("_found"), "_kind").alias("_point"))
    # networks as wide as a range and wider: the innermost holds where the range begins
    wide = F.transform(F.sequence(F.lit(1), F.length("_range")), lambda n: F.substring(F.col("_range"), F.lit(1), n))
    first = counts.select("_range", F.explode(wide).alias("entry")).join(parts.where(~inside), "entry").groupBy("_range").agg(
        F.max_by(F.struct(F.col("facts").alias("_found")), F.length("entry")).alias("_point"))
    points = points.join(counts, "_range", "left_semi").unionByName(first.select("_range", F.lit("").alias("_at"), "_point"))
    points = dealt(points).select("_range", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_at", "_point")

    # rows without a key look nothing up and only need spreading; columns nobody reads are not shuffled
    spread = F.concat(F.lit("~"), F.pmod(F.col("_number"), F.lit(_SPREAD)).cast("string"))
    place = F.col(key)
    events = rows.withColumns({"_number": F.monotonically_increasing_id(), "_event": F.lit(True)})
    events = dealt(events.withColumn("_range", F.coalesce(_range(place), spread)))
    events = events.withColumns({"_part": F.pmod(F.col("_number"), F.col("_parts")).cast("int"), "_at": F.coalesce(place, F.lit(""))}).drop("_number", "_parts")
    both = events.unionByName(points, allowMissingColumns=True)
    # a point comes before the rows of its own address
    so_far = Window.partitionBy("_range", "_part").orderBy("_at", F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_last", F.last("_point", ignorenulls=True).over(so_far)).where("_event")
    return told.select(*rows.columns, F.col("_last._found").alias(out))
