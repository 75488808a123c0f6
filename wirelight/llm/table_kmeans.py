"""Centroid clustering of whole-number vectors by scalar lookup tables.

A component x becomes the integer floor(256 * x). Vectors are stored in blocks
whose components are codes into the block's *occurring* values, dimension by
dimension. A round tabulates (value - centroid)**2 for each dimension, occurring
value and centroid; the distances of a block are then table gathers and sums, and
nothing is multiplied per vector. All arithmetic is exact.

The driver holds the centroids only. Sums of a round leave a task as one row per
centroid, dimension and limb (24 bits of a sum that doesn't fit 64 bits, else the
whole sum) and are added up by Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.llm.workspace import Workspace, few_rows

BLOCK = 8192
STEP = 512  # vectors whose distances are summed at a time
BLOCKS_PER_BATCH = 16
NARROW = 1 << 26  # below it, 64 squared differences fit a signed 64-bit number
LIMB = 24
LONG = (1 << 63) - 1


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has that many components, none NULL or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) as int64, or as Python's integers where some are large."""
    if not len(vectors) or np.abs(vectors).max() < NARROW / 256:
        return np.floor(vectors * 256.0).astype(np.int64)
    return np.array([[math.floor(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256.0) for x in v] for v in vectors.tolist()], dtype=object)


def encode(numbers: np.ndarray) -> tuple[list[str] | None, bytes, bytes, bytes]:
    """A block as (wide values or None, narrow values, where each dimension's values begin, codes)."""
    values, begin, codes = [], [0], np.empty(numbers.shape, dtype=np.uint32)
    for d in range(numbers.shape[1]):
        column = numbers[:, d]
        order = np.argsort(column, kind="stable")
        ranked = column[order]
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        codes[order, d] = np.cumsum(new) - 1 + begin[-1]
        values.append(ranked[new])
        begin.append(begin[-1] + len(values[-1]))
    flat = np.concatenate(values)
    wide = [str(v) for v in flat] if numbers.dtype == object else None
    return wide, b"" if wide else flat.tobytes(), np.array(begin, dtype=np.int64).tobytes(), codes.astype(np.uint16 if begin[-1] <= 1 << 16 else np.uint32).tobytes()


def decode(wide: list[str] | None, narrow: bytes, begin: bytes, codes: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.frombuffer(begin, dtype=np.int64)
    values = np.array([int(v) for v in wide], dtype=object) if wide else np.frombuffer(narrow, dtype=np.int64)
    dims = len(starts) - 1
    return values, starts, np.frombuffer(codes, dtype=np.uint16 if len(codes) == 2 * n * dims else np.uint32).reshape(n, dims)


def tabulate(values: np.ndarray, starts: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared difference of each occurring value and each centroid in the value's dimension."""
    large = values.dtype == object or any(abs(x) >= NARROW for c in centroids for x in c)
    middle = np.array(centroids, dtype=object if large else np.int64)
    dimension = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return ((values.astype(object) if large else values)[:, None] - middle[:, dimension].T) ** 2


def nearest(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number) and squared distance of each vector, by gathers and sums."""
    cluster, distance = np.empty(len(codes), dtype=np.int64), np.empty(len(codes), dtype=table.dtype)
    for lo in range(0, len(codes), STEP):
        part = codes[lo : lo + STEP]
        total = table[part[:, 0]]
        for d in range(1, codes.shape[1]):
            total += table[part[:, d]]
        best = np.argmin(total, axis=1).astype(np.int64)
        cluster[lo : lo + STEP], distance[lo : lo + STEP] = best, total[np.arange(len(part)), best]
    return cluster, distance


def limbs(number: int) -> list[int]:
    """Signed parts that give the number as sum(part << 24 * place); one part if it fits 62 bits."""
    if abs(number) < 1 << 62:
        return [number]
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _blocks(dims: int, block: int, schema: pa.Schema):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def one() -> pa.RecordBatch:
            numbers = whole_numbers(np.concatenate(held))
            wide, narrow, begin, codes = encode(numbers)
            return pa.RecordBatch.from_pylist([{"ids": ids, "wide": wide, "narrow": narrow, "begin": begin, "codes": codes}], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
                if len(ids) >= block:
                    yield one()
                    ids, held = [], []
        if ids:
            yield one()

    return build


def _rows(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        yield row["ids"], decode(row["wide"], row["narrow"], row["begin"], row["codes"], len(row["ids"]))


def _sums(centroids: list[list[int]]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, (values, starts, codes) in _rows(batch):
                cluster, _ = nearest(tabulate(values, starts, centroids), codes)
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total = np.add.reduceat(values[codes[order]], first, axis=0)
                for at, (c, n) in enumerate(zip(cluster[order][first].tolist(), np.diff(first, append=len(order)).tolist(), strict=True)):
                    entry = found.setdefault(c, [0, [0] * codes.shape[1]])
                    entry[0] += n
                    entry[1] = [x + int(y) for x, y in zip(entry[1], total[at], strict=True)]
        out = [(c, d, place, part, n if d == place == 0 else 0) for c, (n, sums) in found.items() for d, s in enumerate(sums) for place, part in enumerate(limbs(s))]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["cluster", "dim", "place", "part", "n"])

    return add


def _assign(centroids: list[list[int]], id_type: pa.DataType):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (values, starts, codes) in _rows(batch):
                cluster, distance = nearest(tabulate(values, starts, centroids), codes)
                fits = [int(x) if x <= LONG else None for x in distance.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"])

    return give


def moved(centroids: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """Centroids after a round: the floor of the exact mean; one without vectors stays."""
    total: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    each = sums.groupBy("cluster", "dim", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("n").alias("n"))
    for row in each.collect():  # centroids x dimensions x limbs
        key = (row.cluster, row.dim)
        total[key] = total.get(key, 0) + (int(row.part) << LIMB * row.place)
        counts[row.cluster] = counts.get(row.cluster, 0) + row.n
    return [[total[c, d] // counts[c] for d in range(len(old))] if counts.get(c) else old for c, old in enumerate(centroids)]


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: str = "2:", block: int = BLOCK,
) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are NULL, of another length, or hold NULL or non-finite components
    are left out. The `k` vectors with the smallest sha256 of `seed` and id start
    (ties: smaller components first; a NULL id is the empty text); with fewer
    vectors there are fewer centroids, and without any no rows. Rows with one id are
    vectors of their own. Distances and inertias over 2**63 - 1, which components of
    some 10**8 and more can give, are NULL; clusters are exact all the same. Other
    columns are neither read nor returned.
    """
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType
    as_doubles = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), as_doubles.alias("vector")).where(usable(F.col("vector"), dims))
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("wide", T.ArrayType(T.StringType()))] + [T.StructField(c, T.BinaryType()) for c in ("narrow", "begin", "codes")])
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    blocks = space.keep(kept.mapInArrow(_blocks(dims, block, to_arrow_schema(schema)), schema), "blocks")
    rank = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = kept.orderBy(rank, "vector").limit(k).select("vector").collect()
    centroids = [[int(x) for x in whole_numbers(np.array([row.vector], dtype=np.float64))[0]] for row in starts]
    out = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    with few_rows(spark, BLOCKS_PER_BATCH):
        for _ in range(rounds if centroids else 0):
            centroids = moved(centroids, blocks.mapInArrow(_sums(centroids), "cluster int, dim int, place int, part long, n long"))
        given = space.keep(blocks.mapInArrow(_assign(centroids, to_arrow_type(kind)), out), "given")
    space.close("given")
    inertia = {r.cluster: None if r.wide else int(r.total) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.max(F.col("distance").isNull()).alias("wide")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    facts = [
        (c, x if x is None or x <= LONG else None, total if total is None or total <= LONG else None, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, x in inertia.items()
    ]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return given.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
