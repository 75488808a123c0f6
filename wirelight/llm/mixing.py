"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal numbers of documents. With
weights a/Q (whole numbers that sum to Q), block k of a source may start at slot
floor((k - 1) * Q / a) and is due by ceil(k * Q / a); of the released blocks the
one due first takes the slot. Every prefix of slots then holds each source's
share with less than one block of deviation.

The schedule repeats after Q slots, so only Q slots are ever worked out; blocks
find theirs by arithmetic. When a source ends, the others' weights are scaled up
and a new phase starts, so nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelight.llm.workspace import Workspace

SLOTS = 1000
BLOCK = 16
BUCKETS = 64
SOURCES = 10_000  # distinct sources a call accepts


def whole_weights(weights: Mapping[str | None, float], slots: int = SLOTS) -> dict[str | None, int]:
    """Weights as whole numbers that sum to `slots` (or more, for many sources), at least 1 each, by largest remainders."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    slots = max(slots, 2 * len(names))
    total = sum(Fraction(weights[s]) for s in names)
    exact = {s: Fraction(weights[s]) / total * (slots - len(names)) + 1 for s in names}
    out = {s: int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (out[s] - exact[s], names.index(s)))[: slots - sum(out.values())]:
        out[s] += 1
    return out


def cycle(weights: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """The (source, block) of each slot of one period, blocks from 0."""
    total, names = sum(weights.values()), list(weights)
    start = lambda i, k: k * total // weights[names[i]]
    due = lambda i, k: -(-(k + 1) * total // weights[names[i]])
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, k), i, k))
        _, i, k = heapq.heappop(ready)
        out.append((names[i], k))
        if k + 1 < weights[names[i]]:
            heapq.heappush(waiting, (start(i, k + 1), i, k + 1))
    return out


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], slots: int = SLOTS) -> list[dict]:
    """Phases in order, each with its whole weights, first slot, length and blocks done before it.

    A phase ends with the slot in which one of its sources places its last block.
    """
    done, at, out = dict.fromkeys(blocks, 0), 0, []
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        share = whole_weights({s: weights[s] for s in left}, slots)
        order = cycle(share)
        place = {(s, k): i for i, (s, k) in enumerate(order)}
        length = min((n - 1) // share[s] * len(order) + place[s, (n - 1) % share[s]] + 1 for s, n in left.items())
        periods, rest = divmod(length, len(order))
        out.append({"first": at, "length": length, "weights": share, "order": order, "done": dict(done)})
        for s in left:
            done[s] += periods * share[s]
        for s, _ in order[:rest]:
            done[s] += 1
        at += length
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """`docs` with `slot` (the block's place), `phase` and `position` (the row's place, from 0 and without gaps).

    Weights are those given, or the sources' numbers of rows to `power`; a source
    without a given weight gets the smallest given one. NULL is a source of its
    own. Rows of a source stand in the order of a hash of their id; ties and
    repeated rows stand next to each other and all stay. An empty table gives no
    rows. Columns of these names are replaced; all others stay. More than 10,000
    sources raise ValueError, as their counts are handled by the driver.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    docs = docs.drop("slot", "phase", "position")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    placed = docs.withColumn("_key", key).withColumn("_hash", F.xxhash64(F.col(id_col)))
    placed = placed.withColumn("_bucket", F.shiftright("_hash", 64 - BUCKETS.bit_length() + 1).cast("int"))
    sizes = placed.groupBy("_key", "_bucket").count().limit(SOURCES * BUCKETS + 1).collect()
    names = {r._key for r in sizes}
    if len(names) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    before, counts = [], dict.fromkeys(names, 0)
    for r in sorted(sizes, key=lambda r: (r._key, r._bucket)):
        before.append((r._key, r._bucket, counts[r._key]))
        counts[r._key] += r["count"]
    plain = {n: n[1:] if n[0] == "s" else None for n in names}
    wanted = {n: float(counts[n]) ** power for n in names} if weights is None else {n: float(weights.get(plain[n], min(weights.values(), default=1.0))) for n in names}
    plan = phases({n: -(-c // block) for n, c in counts.items()}, wanted, slots)

    bounds = [(i, n, p["done"][n], p["done"][n] + used, p["weights"][n], p["first"], len(p["order"])) for i, p in enumerate(plan) for n in p["weights"] if (used := _used(p, n))]
    table = [(i, n, k, at) for i, p in enumerate(plan) for at, (n, k) in enumerate(p["order"])]
    offsets = F.broadcast(spark.createDataFrame(before, "_k string, _b int, _before long"))
    rows = placed.join(offsets, (F.col("_key") == F.col("_k")) & (F.col("_bucket") == F.col("_b"))).drop("_k", "_b")
    within = Window.partitionBy("_key", "_bucket").orderBy("_hash", id_col)
    rows = rows.withColumn("_row", F.col("_before") + F.row_number().over(within) - 1).withColumn("_block", F.expr(f"_row div {block}"))
    ranges = F.broadcast(spark.createDataFrame(bounds, "_phase int, _k string, _from long, _to long, _share long, _first long, _period long"))
    rows = rows.join(ranges, (F.col("_key") == F.col("_k")) & (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to")))
    slots_of = spark.createDataFrame(table, "_p int, _n string, _at_block long, _at long")
    slots_of = space.keep(slots_of, "slots")
    at = F.col("_block") - F.col("_from")
    rows = rows.join(F.broadcast(slots_of), (F.col("_phase") == F.col("_p")) & (F.col("_key") == F.col("_n")) & (at % F.col("_share") == F.col("_at_block")))
    rows = rows.withColumn("slot", F.col("_first") + F.expr("(_block - _from) div _share") * F.col("_period") + F.col("_at"))
    # A source's last block may be short; each such block shifts what follows it.
    short = sorted((_slot_of(plan, n, -(-c // block) - 1), -(-c // block) * block - c) for n, c in counts.items() if c % block)
    gaps, lost, last = [], 0, -1
    for s, missing in short:
        gaps.append((last, s, lost))
        last, lost = s, lost + missing
    gaps.append((last, 1 << 62, lost))
    lack = F.broadcast(spark.createDataFrame(gaps, "_after long, _until long, _lost long"))
    rows = rows.join(lack, (F.col("slot") > F.col("_after")) & (F.col("slot") <= F.col("_until")))
    rows = rows.withColumn("position", F.col("slot") * block + F.col("_row") % block - F.col("_lost"))
    return rows.select(*docs.columns, F.col("slot"), F.col("_phase").alias("phase"), F.col("position"))


def _used(phase: dict, name: str) -> int:
    periods, rest = divmod(phase["length"], len(phase["order"]))
    return periods * phase["weights"][name] + sum(n == name for n, _ in phase["order"][:rest])


def _slot_of(plan: list[dict], name: str, block: int) -> int:
    for p in plan:
        if name in p["weights"] and block < p["done"][name] + _used(p, name):
            at, share = block - p["done"][name], p["weights"][name]
            return p["first"] + at // share * len(p["order"]) + p["order"].index((name, at % share))
    raise ValueError(f"block {block} of {name} has no slot")
