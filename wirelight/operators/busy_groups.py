"""``dedup_last8`` for groups too large for one task.

Which rows are kept depends on the rows kept before, so a group is one chain. The
chain is cut into slices all the same:

1. Rows are dealt by ranges of (group, order); every slice of a group is run as if
   nothing came before it, all slices at once.
2. A slice that continues a group is replayed from the eight keys the slice before
   ended with, next to its first run, until both remember the same eight keys. From
   there on the first run was right. Rows judged otherwise up to there are noted.
3. A slice in which the two never meet ends with other keys than it first did, so
   the next one is replayed again, round by round until nothing changes. What is
   still open after a number of rounds (few different keys for very long) is
   replayed slice after slice in one task per group.

The result is that of the chain. The driver holds eight keys per slice.

What a group's rows of earlier batches left behind, its last kept keys, comes before
the rows as rows of its own: eight different keys are all kept, so a run that begins
with them remembers just them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.operators.dedup import LOOK_BACK, keep_unlike_recent, query_key
from wirelight.operators.lookup import materialise

HEAD = 20_000
ROUNDS = 6

_ENDS = "array<string>"


def _first_run(schema: pa.Schema):
    """Rows of a slice by group and order -> the same with ``_kept``; behind a group's part one row with its last keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, slice_, part = None, deque(maxlen=LOOK_BACK), None, 0

        def end(last: bool) -> pa.RecordBatch:
            row = {"_slice": slice_, "_group": group, "_part": part, "_last": last, "_ends": list(seen)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            groups, keys = batch.column(batch.schema.get_field_index("_group")).to_pylist(), batch.column(batch.schema.get_field_index("_key")).to_pylist()
            if groups:
                slice_ = batch.column(batch.schema.get_field_index("_slice"))[0].as_py()
            start, kept = 0, []
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}

            def out(start: int, stop: int, kept: list[bool]) -> pa.RecordBatch:
                n = stop - start
                known = {"_kept": pa.array(kept, pa.bool_()), "_part": pa.array([part] * n, pa.int32())}
                return pa.RecordBatch.from_arrays(
                    [known[f.name] if f.name in known else columns[f.name].slice(start, n) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

            for at, name in enumerate(groups):
                if name != group:
                    if group is not None:
                        yield out(start, at, kept)
                        yield end(False)
                        part += 1
                    start, kept = at, []
                    group, seen = name, deque(maxlen=LOOK_BACK)
                kept += keep_unlike_recent(seen, [keys[at]])
            if groups:
                yield out(start, len(groups), kept)
        if group is not None:
            yield end(True)

    return run


def _replay(starts: dict[int, list[str] | None]):
    """Rows (_slice, _pos, _key) in order -> rows judged otherwise than in the first run, and how each slice ended.

    ``starts`` has the keys a slice starts from; None: those the slice before ended with.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, true, first, met = None, deque(maxlen=LOOK_BACK), deque(maxlen=LOOK_BACK), False
        names = ["_slice", "_pos", "_met", "_ends"]

        def rows(slices, places, mets, ends) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(places, pa.int64()), pa.array(mets, pa.bool_()), pa.array(ends, pa.list_(pa.string()))], names=names)

        def done() -> pa.RecordBatch:
            return rows([slice_], [None], [met], [list(true)])

        for batch in batches:
            other: list[int] = []
            at_slice = []
            for s, pos, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != slice_:
                    if slice_ is not None:
                        yield done()
                    start = starts[s]
                    true = deque(true if start is None else start, maxlen=LOOK_BACK)
                    slice_, first, met = s, deque(maxlen=LOOK_BACK), False
                    met = not true
                if met and starts.get(s) is not None:
                    continue
                a, b = keep_unlike_recent(true, [key])[0], keep_unlike_recent(first, [key])[0]
                if a != b:
                    other.append(pos)
                    at_slice.append(s)
                met = met or true == first
            if other:
                yield rows(at_slice, other, [None] * len(other), [None] * len(other))
        if slice_ is not None:
            yield done()

    return run


@dataclass
class _Slice:
    """What the driver knows of a slice: its first and its last group's parts (often one), and the keys they ended with."""

    first: str = ""
    first_ends: list | None = None
    last: str = ""
    last_ends: list | None = None
    whole: bool = False


def dedup_last8_sliced(rows: DataFrame, group: list[str], order: list[str], key: list[str], slices: int | None = None) -> DataFrame:
    """As ``dedup_last8``; a group may hold all rows. ``order`` must tell a group's rows apart."""
    return last8_from(rows, group, order, key, None, slices)[0]


def last8_from(
    rows: DataFrame, group: list[str], order: list[str], key: list[str], before: DataFrame | None, slices: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``dedup_last8_sliced`` that goes on from what groups remember, and what they remember then.

    ``before`` and the second result have a row (_group, _ends) per group: its
    ``query_key`` and its last kept keys, oldest first. Groups without rows stay.
    """
    spark = rows.sparkSession
    n = slices or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tagged = rows.select(F.struct(*rows.columns).alias("_row"), query_key(group).alias("_group"), query_key(key).alias("_key"), F.struct(*order).alias("_order"), F.lit(LOOK_BACK).alias("_place"))
    if before is not None:
        nothing = [F.lit(None).cast(tagged.schema[c].dataType).alias(c) for c in ("_row", "_order")]
        tagged = tagged.unionByName(before.select("_group", F.posexplode("_ends").alias("_place", "_key"), *nothing))
    inside = ["_group", "_place", "_order"]
    dealt = tagged.repartitionByRange(n, *inside).sortWithinPartitions(*inside).drop("_order", "_place")
    dealt = dealt.withColumns({"_slice": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()})
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, t) for c, t in (
        ("_kept", T.BooleanType()), ("_part", T.IntegerType()), ("_last", T.BooleanType()), ("_ends", T.ArrayType(T.StringType()))))])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = materialise(dealt.mapInArrow(_first_run(to_arrow_schema(schema)), schema), "slices")
    known: dict[int, _Slice] = {}
    # two rows per slice at most
    for r in run.where("_last IS NOT NULL AND (_last OR _part = 0)").select("_slice", "_group", "_part", "_last", "_ends").collect():
        s = known.setdefault(r["_slice"], _Slice())
        if r["_part"] == 0:
            s.first, s.first_ends = r["_group"], r["_ends"]
        if r["_last"]:
            s.last, s.last_ends, s.whole = r["_group"], r["_ends"], r["_part"] == 0
    # per slice the table with the rows judged otherwise
    flips: dict[int, DataFrame] = {}
    # where a slice's first group ended, as far as it isn't as in the first run
    closed: dict[int, list] = {}
    ends = {i: s.last_ends for i, s in known.items()}
    used: dict[int, list] = {}
    in_order = sorted(known)
    previous = {s: p for p, s in zip(in_order, in_order[1:]) if known[p].last == known[s].first}

    def replay(starts: dict[int, list | None], head: int | None, by: dict[int, int]) -> list:
        some = run.where(F.col("_slice").isin(list(starts)) & (F.col("_part") == 0) & F.col("_last").isNull())
        if head is not None:
            some = some.where(F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) < head)
        chain = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col("_slice")]
        together = some.select("_slice", "_pos", "_key", chain.alias("_chain")).repartition("_chain").sortWithinPartitions("_chain", "_slice", "_pos").drop("_chain")
        found = materialise(together.mapInArrow(_replay(starts), f"_slice int, _pos long, _met boolean, _ends {_ENDS}"), "replayed")
        told = found.where("_met IS NOT NULL").collect()
        settled = [r["_slice"] for r in told if r["_met"] or head is None]
        flips.update(dict.fromkeys(settled, found))
        return told

    def settle(told: list) -> None:
        for r in told:
            s = r["_slice"]
            closed[s] = known[s].first_ends if r["_met"] else r["_ends"]
            if known[s].whole:
                ends[s] = closed[s]

    for _ in range(ROUNDS):
        todo = {s: ends[p] for s, p in previous.items() if used.get(s) != ends[p]}
        if not todo:
            break
        used |= todo
        told = replay(todo, HEAD, {s: s for s in todo})
        open_ = {r["_slice"]: todo[r["_slice"]] for r in told if not r["_met"]}
        settle([r for r in told if r["_met"]])
        if open_:
            settle(replay(open_, None, {s: s for s in open_}))
    left = sorted(s for s, p in previous.items() if used.get(s) != ends[p])
    if left:
        # from a group's first open slice on, in one task per group
        chains: dict[int, int] = {}
        starts: dict[int, list | None] = {}
        for s in in_order:
            p = previous.get(s)
            if p in chains and known[p].whole:
                chains[s], starts[s] = chains[p], None
            elif s in left:
                chains[s], starts[s] = s, ends[p]
        settle(replay(starts, None, chains))
    result = run.where("_last IS NULL AND _row IS NOT NULL")
    tables = {id(found): found for found in flips.values()}
    if tables:
        some = [found.where(F.col("_pos").isNotNull() & F.col("_slice").isin([s for s, f in flips.items() if f is found])) for found in tables.values()]
        other = materialise(reduce(DataFrame.unionByName, some).select(F.col("_pos").alias("_other")), "flips")
        result = result.join(other, F.col("_pos") == F.col("_other"), "left").where(F.col("_kept") != F.col("_other").isNotNull())
    else:
        result = result.where("_kept")
    # a slice's last group may go on in the next one
    goes_on = set(previous.values())
    told = [(s, closed.get(s), s in goes_on) for s in in_order]
    told = spark.createDataFrame(told, f"_slice int, _closed {_ENDS}, _goes_on boolean")
    final = run.where("_last IS NOT NULL").join(F.broadcast(told), "_slice").where(~(F.col("_last") & F.col("_goes_on")))
    left_by = F.coalesce(F.when(F.col("_part") == 0, F.col("_closed")), "_ends")
    return result.select("_row.*"), final.select("_group", left_by.alias("_ends"))
