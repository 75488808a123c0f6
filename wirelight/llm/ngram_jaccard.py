"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word shingles. All shingles have one global
order, rare ones first. The order is cut into fragments; each fragment counts
the shingles that two candidates share inside it, and the counts of a pair are
summed over the fragments and held against the threshold. Nothing is estimated.

1. One pass over the texts counts shingles in a fixed-size sketch (all rows, no
   sample). The global order is (sketch count, shingle): any total order gives
   right results, this one puts frequent passages last.
2. Similar sets share a shingle of their first quarter. A second pass sends only
   these prefixes to buckets, which keep the shingles of two or more sets.
3. First, neighbours in each posting list (under three orders) are verified and
   joined to components. Then every pair of a list whose members lie in different
   components and whose sizes and positions allow the threshold is verified. Pairs
   inside a component needn't be: no component is lost, and groups of copies are
   never expanded into all pairs.
4. Verification first counts over the prefixes alone: a pair whose prefixes share
   too little can't reach the threshold. Only for what is left the whole sets go
   to the fragments.
5. Candidates travel as arrays per set and verification block, not as rows.

Equal sets are one class, so exact copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.llm.shingles import mix, set_number, shingle_sets
from wirelight.llm.workspace import Workspace, connected, look_up

CELLS = 1 << 20  # of the sketch: 4 MB on every executor, whatever the input
CELL_ROWS = 64
BUCKET = 400_000  # postings a bucket, on average; a shingle with more is split over several
BLOCK = 50_000  # sets a verification block
FRAGMENTS = 16
SHORT_LIST = 32
BROADCAST_IDS = 2_000_000  # 16 bytes each


class GlobalOrder:
    """Places of shingles in the global order, from the counts of the sketch."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)

    def sort(self, shingles: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles in the global order; ties stay in number order."""
        return shingles[np.argsort(self.of(shingles), kind="stable")]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self.counts[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]

    def pivots(self, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count values, and for each the share of all occurrences before it and at it, in fragments."""
        values, cells = np.unique(self.counts[self.counts > 0], return_counts=True)
        share = values.astype(np.float64) * cells
        share *= fragments / max(share.sum(), 1)
        return values, np.cumsum(share) - share, share


def prefix_length(n: int, percent: int) -> int:
    """Sets of which one shares nothing with this much of the other can't reach the threshold."""
    return n - -(-percent * n // 100) + 1


def _may_link(nx, ny, px, py, percent: int) -> np.ndarray:
    """Whether sizes, and places of a first common shingle, allow the threshold."""
    most = np.minimum(nx - px, ny - py)
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((100 + percent) * most >= percent * (nx + ny))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema[0].dataType), T.StructField("n", T.LongType()), T.StructField("klass", T.LongType()), T.StructField("cell_row", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, task = np.zeros(CELLS, dtype=np.int64), TaskContext.get().partitionId()
        for ids, texts in _texts(batches):
            sets = list(shingle_sets(texts, size))
            if some := [s for s in sets if len(s)]:
                total += np.bincount((np.concatenate(some) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
        if total.any():
            parts = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).reshape(CELL_ROWS, -1)
            n = CELL_ROWS
            kind = pa.array([], type=ids.type).type
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sum_cells(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(c, dtype=np.uint32).astype(np.int64) for c in rows["counts"]), np.int64(0))
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pd.DataFrame({"cell_row": [key[0]], "task": [0], "counts": [total.tobytes()]})


def _order(first: DataFrame) -> GlobalOrder:
    rows = first.where("cell_row IS NOT NULL").select("cell_row", "task", "counts")
    schema = "cell_row int, task int, counts binary"
    some = rows.groupBy("cell_row", F.pmod("task", F.lit(32)).alias("part")).applyInPandas(_sum_cells, schema)
    counts = np.zeros((CELL_ROWS, CELLS // CELL_ROWS), dtype=np.int64)
    for row in some.groupBy("cell_row").applyInPandas(_sum_cells, schema).toLocalIterator():
        counts[row.cell_row] = np.frombuffer(row.counts, dtype=np.uint32)
    return GlobalOrder(counts.ravel())


def _prefixes(docs: DataFrame, order, buckets: int, size: int, percent: int) -> DataFrame:
    """Packed postings (shingle, class, size, place) of the prefixes, by bucket. A class is sent once by a task, as far as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sent = order.value, set()
        for _, texts in _texts(batches):
            if len(sent) > 1_000_000:
                sent = set()
            parts: list[tuple[np.ndarray, int, int]] = []
            for s in shingle_sets(texts, size):
                number = set_number(s)
                if len(s) and number not in sent:
                    sent.add(number)
                    parts.append((places.sort(s)[: prefix_length(len(s), percent)], number, len(s)))
            if not parts:
                continue
            lengths = np.array([len(p[0]) for p in parts])
            shingle = np.concatenate([p[0] for p in parts])
            place = np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            owner = np.repeat(np.arange(len(parts)), lengths)
            klass, n = np.array([p[1] for p in parts], dtype=np.int64), np.array([p[2] for p in parts], dtype=np.int32)
            split = places.of(shingle) // BUCKET
            bucket = ((shingle >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            hot = split > 0
            bucket[hot] = ((bucket[hot] + mix(klass[owner[hot]].view(np.uint64)).astype(np.int64) % (split[hot] + 1)) % buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            out = []
            for rows in np.split(by, cuts):
                seen, at = np.unique(owner[rows], return_inverse=True)
                out.append((int(bucket[rows[0]]), shingle[rows].tobytes(), at.astype(np.int32).tobytes(), place[rows].astype(np.int32).tobytes(), klass[seen].tobytes(), n[seen].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["bucket", "shingle", "at", "place", "klass", "n"])

    return docs.mapInArrow(run, "bucket int, shingle binary, at binary, place binary, klass binary, n binary")


def _has_partner(shingle, n, place, percent: int) -> np.ndarray:
    """Postings that may link with another of their list; in lists beyond SHORT_LIST all do for now."""
    keep = np.zeros(len(shingle), dtype=bool)
    for step in range(1, SHORT_LIST + 1):
        like = np.flatnonzero(shingle[step:] == shingle[:-step])
        if not len(like):
            break
        ok = like[_may_link(n[like], n[like + step], place[like], place[like + step], percent)] if step < SHORT_LIST else like
        keep[ok] = keep[ok + step] = True
    if len(shingle) > SHORT_LIST:
        first = np.r_[True, shingle[1:] != shingle[:-1]]
        long = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > SHORT_LIST
        keep |= long
    return keep


def _shared(order, percent: int):
    """A bucket's postings of shingles that two classes have (y NULL), and pairs of neighbours in their lists (y set).

    Of a shingle that is split over buckets every posting stays, as its partners may lie in another one.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for r in rows.itertuples(index=False):
            at = np.frombuffer(r.at, dtype=np.int32)
            for col, x in zip(cols, (np.frombuffer(r.shingle, dtype=np.int64), np.frombuffer(r.klass, dtype=np.int64)[at], np.frombuffer(r.n, dtype=np.int32)[at].astype(np.int64), np.frombuffer(r.place, dtype=np.int32)), strict=True):
                col.append(x)
        shingle, klass, n, place = (np.concatenate(c) for c in cols)
        by = np.lexsort((klass, n, shingle))
        shingle, klass, n, place = shingle[by], klass[by], n[by], place[by]
        keep = np.ones(len(by), dtype=bool)
        keep[1:] = (shingle[1:] != shingle[:-1]) | (klass[1:] != klass[:-1])
        shingle, klass, n, place = shingle[keep], klass[keep], n[keep], place[keep]
        split = order.value.of(shingle.view(np.uint64)) >= BUCKET
        keep = _has_partner(shingle, n, place, percent) | split
        shingle, klass, n, place, split = shingle[keep], klass[keep], n[keep], place[keep], split[keep]
        found = []
        for turn in range(3):
            by = np.arange(len(shingle)) if not turn else np.lexsort((mix(klass.view(np.uint64) + np.uint64(turn)), shingle))
            a, b = by[:-1], by[1:]
            ok = (shingle[a] == shingle[b]) & _may_link(n[a], n[b], place[a], place[b], percent)
            found.append(np.stack([np.minimum(klass[a], klass[b])[ok], np.maximum(klass[a], klass[b])[ok]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        none = np.full(len(shingle), pd.NA, dtype=object)
        postings = pd.DataFrame({"shingle": shingle, "klass": klass, "n": n, "place": place.astype(np.int64), "y": pd.array(none, dtype="Int64"), "split": split})
        near = pd.DataFrame({"shingle": 0, "klass": pairs[:, 0], "n": 0, "place": 0, "y": pd.array(pairs[:, 1], dtype="Int64"), "split": False})
        return pd.concat([postings, near], ignore_index=True)

    return run


def _across(percent: int):
    """Pairs of a list that lie in different components, as arrays per set. At least one of a pair lies outside the list's commonest component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shingle", "grid"], kind="stable")
        shingle, grid, klass, n, place, comp, role = (rows[c].to_numpy() for c in ("shingle", "grid", "klass", "n", "place", "component", "role"))
        cuts = np.flatnonzero((shingle[1:] != shingle[:-1]) | (grid[1:] != grid[:-1])) + 1
        found: dict[int, list[np.ndarray]] = {}
        for start, end in zip([0, *cuts], [*cuts, len(shingle)], strict=True):
            part = slice(start, end)
            y = np.flatnonzero(role[part] != 1) + start
            for x in np.flatnonzero(role[part] != 0) + start:
                ok = (comp[y] != comp[x]) & _may_link(n[x], n[y], place[x], place[y], percent)
                if ok.any():
                    found.setdefault(int(klass[x]), []).append(klass[y[ok]])
        return pd.DataFrame({"x": pd.Series(list(found), dtype="int64"), "ys": pd.Series([np.unique(np.concatenate(v)) for v in found.values()], dtype=object)})

    return run


def _segments(docs: DataFrame, order, size: int, percent: int, whole: bool) -> DataFrame:
    """Each class's shingles, or those of its prefix, cut at the pivots of the global order: (klass, n, fragment, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sent = order.value, set()
        values, before, share = places.pivots(FRAGMENTS)
        for _, texts in _texts(batches, 500):
            out = []
            for s in shingle_sets(texts, size):
                number, n = set_number(s), len(s)
                if not n or number in sent:
                    continue
                if len(sent) < 1_000_000:
                    sent.add(number)
                if not whole:
                    s = np.sort(places.sort(s)[: prefix_length(n, percent)])
                at = np.searchsorted(values, places.of(s))
                fragment = np.minimum((before[at] + share[at] * (s.astype(np.float64) / 2.0**64)).astype(np.int64), FRAGMENTS - 1)
                by = np.argsort(fragment, kind="stable")
                for rows in np.split(by, np.flatnonzero(np.diff(fragment[by])) + 1):
                    out.append((number, n, int(fragment[rows[0]]), s[rows].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=["klass", "n", "fragment", "segment"])

    return docs.mapInArrow(run, "klass long, n long, fragment int, segment binary")


def _partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Shingles of one fragment that each x shares with each of its candidates."""
    right = right.drop_duplicates("klass").sort_values("klass")
    known, sizes, comps = (right[c].to_numpy() for c in ("klass", "n", "component"))
    segments = [np.frombuffer(s, dtype=np.uint64) for s in right["segment"]]
    out = []
    for row in left.itertuples(index=False):
        ys = np.asarray(row.ys, dtype=np.int64)
        at = np.searchsorted(known, ys)
        at[at == len(known)] = 0
        at = at[known[at] == ys] if len(known) else at[:0]
        if not len(at):
            continue
        mine = np.frombuffer(row.own, dtype=np.uint64)
        theirs = np.concatenate([segments[i] for i in at])
        place = np.searchsorted(mine, theirs)
        place[place == len(mine)] = 0
        owner = np.repeat(np.arange(len(at)), [len(segments[i]) for i in at])
        counts = np.bincount(owner[mine[place] == theirs], minlength=len(at))
        some = counts > 0
        if some.any():
            pick = at[some]
            out.append((row.x, row.size, row.block, known[pick].tobytes(), sizes[pick].tobytes(), comps[pick].tobytes(), counts[some].astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["x", "n", "block", "ys", "sizes", "comps", "counts"])


def _sum_pairs(percent: int, whole: bool):
    """Sums the counts of each pair over the fragments.

    Over whole sets the pairs that reach the threshold, one into each component;
    over prefixes those that still can: what the prefix with the nearer end lacks
    is lost, so the overlap is at most the count and the longer rest.
    """

    def finish(held: list) -> np.ndarray:
        n = held[0][0]
        ys, sizes, comps, counts = (np.concatenate([np.frombuffer(h[i], dtype=np.int64) for h in held]) for i in (1, 2, 3, 4))
        y, first, at = np.unique(ys, return_index=True, return_inverse=True)
        total, m = np.bincount(at, weights=counts).astype(np.int64), sizes[first]
        if not whole:
            rest = np.maximum(n - prefix_length(n, percent), m - prefix_length(m, percent))
            return y[(100 + percent) * (total + rest) >= percent * (n + m)]
        linked = 100 * total >= percent * (n + m - total)
        return y[linked][np.unique(comps[first][linked], return_index=True)[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def close() -> None:
            if held and len(ys := finish(held)):
                out.append((*key, ys))
            held.clear()

        def made() -> pa.RecordBatch:
            rows = [pa.array([o[i] for o in out], k) for i, k in enumerate([pa.int64(), pa.int32(), pa.list_(pa.int64())])]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["x", "block", "ys"])

        for batch in batches:
            for x, block, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (x, block) != key:
                    close()
                    key = (x, block)
                held.append(rest)
            yield made()
        close()
        yield made()

    return run


def _counted(probes: DataFrame, segments: DataFrame, blocks: int, percent: int, whole: bool) -> DataFrame:
    """Those of the candidates (x, block, ys) that pass, in the same form; `segments` has a component for each class."""
    own = segments.select(F.col("klass").alias("x"), F.col("n").alias("size"), F.col("fragment").alias("part"), F.col("segment").alias("own"))
    left = probes.join(own, "x").select("part", "block", "x", "size", "own", "ys")
    right = segments.select("fragment", F.pmod("klass", F.lit(blocks)).cast("int").alias("block"), "klass", "n", "component", "segment")
    counted = left.groupBy("part", "block").cogroup(right.groupBy("fragment", "block")).applyInPandas(
        _partial, "x long, n long, block int, ys binary, sizes binary, comps binary, counts binary"
    )
    dealt = counted.select("x", "block", "n", "ys", "sizes", "comps", "counts").repartition("x", "block").sortWithinPartitions("x", "block")
    return dealt.mapInArrow(_sum_pairs(percent, whole), "x long, block int, ys array<long>")


def _by_block(pairs: DataFrame, blocks: int) -> DataFrame:
    """(x, ys) to one row per x and block of ys."""
    each = pairs.select("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ys") if blocks > 1 else pairs.select("x", F.lit(0).alias("block"), "ys")
    if blocks > 1:
        each = each.withColumn("ys", F.expr(f"filter(ys, y -> pmod(y, {blocks}) = block)")).where(F.size("ys") > 0)
    return each.groupBy("x", "block").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) per row of `docs`.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the smallest id reachable over links.
    A NULL, empty or blank text has the empty set and is linked with nothing.
    Repeated rows each give a row; a NULL id is returned and never the smallest
    unless a component has no other. An empty table gives no rows. Other columns
    of `docs` are not read.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = space.keep(_first_pass(docs, size), "first")
    order = spark.sparkContext.broadcast(_order(first))
    members = first.where("cell_row IS NULL").select("id", "n", "klass")
    classes = space.keep(members.where("n > 0").groupBy("klass").agg(F.first("n").alias("n"), F.min("id").alias("least"), F.count("*").alias("members")), "classes")
    prefixes = classes.agg(F.sum((F.col("n") * (100 - percent) / 100 + 2).cast("long"))).first()[0] or 0

    buckets = max(spark.sparkContext.defaultParallelism, 1 + prefixes // BUCKET)
    packed = _prefixes(docs, order, buckets, size, percent)
    both = space.keep(packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_shared(order, percent), "shingle long, klass long, n long, place long, y long, split boolean"), "shared")
    shared = both.where("y IS NULL AND NOT split").select("shingle", "klass", "n", "place")
    if (order.value.counts >= BUCKET).any():
        # Whether a split shingle has two classes is known only over all of its buckets.
        split = both.where("y IS NULL AND split").select("shingle", "klass", "n", "place")
        lists = space.keep(split.groupBy("shingle").agg(F.count("*").alias("members"), (F.count("*") > 1).alias("several")), "split_lists")
        shared = space.keep(shared.union(look_up(split, lists, "shingle", "members").where("several").drop("several")), "split_shared")
    involved = space.keep(shared.select("klass").distinct().join(classes.select("klass", "n", "least"), "klass"), "involved")
    n_involved = involved.count()
    blocks = 1 + n_involved // BLOCK
    prefix_parts = space.keep(_segments(_only(docs, involved), order, size, percent, False), "prefixes")

    def named_by(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows with the component of their class; two numbers per class, so their count is their size."""
        return rows.join(F.broadcast(comps) if n_involved <= BROADCAST_IDS else comps, "klass")

    def links(candidates: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        likely = space.keep(_counted(candidates, named_by(prefix_parts, comps), blocks, percent, False), f"likely{name}")
        named = likely.select(F.col("x").alias("klass")).union(likely.select(F.explode("ys"))).distinct()
        chosen = space.keep(named.join(involved, "klass").select("klass", "least"), f"chosen{name}")
        segments = space.keep(_segments(_only(docs, chosen), order, size, percent, True), f"segments{name}")
        found = _counted(likely, named_by(segments, comps), blocks, percent, True)
        found = space.keep(found.select(F.col("x").alias("a"), F.explode("ys").alias("b")), f"links{name}")
        space.drop(f"likely{name}", f"chosen{name}", f"segments{name}")
        return found

    near = both.where("y IS NOT NULL").select(F.col("klass").alias("x"), F.array("y").alias("ys"))
    found = links(_by_block(near, blocks), involved.select("klass", F.col("klass").alias("component")), "1")
    grouped = space.keep(connected(found, space, "star1-"), "components1")
    comps = involved.select("klass").join(grouped, F.col("klass") == F.col("node"), "left").select("klass", F.coalesce("component", "klass").alias("component"))
    comps = space.keep(comps, "comps")

    listed = named_by(shared, comps)
    by_comp = listed.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    mixed = by_comp.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("common"), F.count("*").alias("comps"), F.sum("c").alias("length")).where("comps > 1")
    listed = listed.join(mixed, "shingle").withColumn("grids", (F.col("length") / BLOCK).cast("int") + 1).withColumn("mine", F.pmod("klass", F.col("grids")).cast("int"))
    every = F.sequence(F.lit(0), F.col("grids") - 1)
    # Role 0: target only, 1: probe only, 2: both. Lists longer than a block are cut into a grid of probes and targets.
    probe = F.col("component") != F.col("common")
    whole = listed.where("grids = 1").withColumn("grid", F.lit(0)).withColumn("role", F.when(probe, 2).otherwise(0))
    cut = listed.where("grids > 1")
    cut = cut.withColumn("role", F.lit(0)).withColumn("other", F.explode(every)).withColumn("grid", F.col("other") * F.col("grids") + F.col("mine")).drop("other").union(
        cut.where(probe).withColumn("role", F.lit(1)).withColumn("other", F.explode(every)).withColumn("grid", F.col("mine") * F.col("grids") + F.col("other")).drop("other")
    )
    lists = space.keep(whole.union(cut).select("shingle", "klass", "n", "place", "component", "grid", "role"), "lists")
    space.drop("shared", "split_lists", "split_shared")
    groups = max(spark.sparkContext.defaultParallelism, 1 + lists.count() // BUCKET)
    pairs = lists.groupBy(F.pmod(F.xxhash64("shingle", "grid"), F.lit(groups)).alias("group")).applyInPandas(_across(percent), "x long, ys array<long>")
    found = found.union(links(_by_block(pairs, blocks), comps, "2"))

    grouped = connected(found, space, "star2-")
    labelled = grouped.join(classes.select(F.col("klass").alias("node"), "least"), "node")
    lowest = space.keep(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "lowest")
    placed = labelled.select(F.col("node").alias("klass"), "component").join(lowest, "component").select("klass", "component_id")
    facts = space.keep(classes.join(placed, "klass", "left").select("klass", "members", F.coalesce("component_id", "least").alias("component_id")), "facts")
    found = look_up(members, facts, "klass", "members")
    result = space.keep(found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "result")
    order.unpersist()
    space.close("result")
    return result


def _only(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for the classes (klass, least)."""
    ids = classes.select(F.col("least").alias("_least"))
    ids = F.broadcast(ids) if classes.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col("id").eqNullSafe(F.col("_least")), "left_semi")
