"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample. A vector is represented by the order of
its nearest pivots. Index rows are dealt into blocks; each block posts its
vectors in one inverted file per pivot, as (vector, place of the pivot). A query
adds up footrule distances over the files of its own nearest pivots, the nearest
share of each block by footrule is measured exactly, and the blocks' best are
merged. Queries meet blocks of rows, so no pair is ever a row; every row is
indexed and the share measured exactly grows with the block, so there is no cap.

Equal vectors are one entry with its smallest ids, as many as can be asked for,
so a vector that a third of the rows share costs one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelight.llm.workspace import Workspace

PIVOTS = 256
PREFIX = 128
SHARE = 0.06
LEAST = 300
BLOCK_ROWS = 10_000
QUERY_ROWS = 1_000


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    apart = (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Block:
    """Pivot inverted files over some vectors."""

    def __init__(self, perms: np.ndarray, pivots: int) -> None:
        n, self.prefix = perms.shape
        flat = perms.ravel()
        by = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.files = [(by[a:b] // self.prefix, (by[a:b] % self.prefix).astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.whole = n, self.prefix * (self.prefix + 1) // 2

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distances of all vectors to a query; a pivot that one of the two lacks counts as placed after the last."""
        n, every = self.whole
        total = np.full(n, 2 * every, dtype=np.int32)
        for place, pivot in enumerate(perm):
            rows, places = self.files[pivot]
            total[rows] += np.abs(places - place) - (self.prefix - place) - (self.prefix - places)
        return total


def _search(k: int, share: float, least: int, pivots_):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "ids": [], "score": []})
        pivots = pivots_.value
        base, queries = (np.stack([np.frombuffer(v, dtype=np.float64) for v in x["vec"]]) for x in (right, left))
        ids = right["ids"].to_numpy()
        prefix = min(PREFIX, len(pivots))
        block = Block(orders(base, pivots, prefix), len(pivots))
        depth = min(len(base), max(least, int(np.ceil(share * len(base)))))
        out = []
        for query, vector, perm in zip(left["query_id"], queries, orders(queries, pivots, prefix), strict=True):
            near = np.argpartition(block.footrule(perm), depth - 1)[:depth]
            apart = np.sqrt(((base[near] - vector) ** 2).sum(axis=1))
            for i in np.lexsort((near, apart))[: k + 1]:
                out.append((query, ids[near[i]], float(apart[i])))
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among all other ids, by Euclidean distance.

    Ties go to the smaller id. Vectors that are NULL, empty, zero or hold NULL,
    NaN or infinite components take no part, nor do rows with a NULL id. A
    repeated id with the same vector is one row, and with several vectors each is
    a candidate. Vectors whose length is not the commonest (then smallest) one
    take no part. Empty tables give no rows; other columns are not read.
    """
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession)

    def sound(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        fine = "NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
        return space.keep(rows.where(fine).withColumn("v", F.expr("transform(v, x -> x + 0.0D)")).distinct(), name)

    rows, asked = sound(vectors, "rows"), sound(queries, "asked")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == usual.n), asked.where(F.size("v") == usual.n)
    # The k + 1 smallest ids of a vector, kept small before and after the shuffle.
    part = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = part.groupBy("v", "part").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    whole = some.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    pack = F.pandas_udf(lambda s: s.map(lambda v: np.asarray(v, dtype=np.float64).tobytes()), "binary")
    entries = space.keep(whole.select("ids", pack("v").alias("vec"), F.xxhash64("v").alias("mark")), "entries")
    n = entries.count()
    picked = entries.orderBy("mark", "ids").select("vec").limit(pivots).collect()
    points = spark.sparkContext.broadcast(np.stack([np.frombuffer(r.vec, dtype=np.float64) for r in picked]))
    blocks = max(min(spark.sparkContext.defaultParallelism, 1 + n // 1000), 1 + n // BLOCK_ROWS)
    turns = 1 + asked.count() // QUERY_ROWS
    base = entries.select(F.pmod("mark", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "ids", "vec")
    mine = asked.select(F.col("id").alias("query_id"), pack("v").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"))
    mine = mine.select("query_id", "vec", "turn", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = mine.groupBy("block", "turn").cogroup(base.groupBy("block", "turn")).applyInPandas(_search(k, share, least, points), "query_id long, ids array<long>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    result = space.keep(ranked, "result")
    space.close("result")
    return result
