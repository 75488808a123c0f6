"""Intermediate tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 512  # a key with more than a 512th of the rows is hot, so at most 512 keys are


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one on a local master where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Workspace:
    """Tables of one operator call. They cut the lineage and outlive lost executors.

    `close` deletes the tables that the result doesn't read; those it reads go
    when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []
        self.root = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        path = f"{self.root}/{name}"
        self.tables.append(path)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def close(self, *keep: str) -> None:
        self.drop(*(p.rsplit("/", 1)[1] for p in self.tables if p.rsplit("/", 1)[1] not in keep))

    def _forget(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


@contextmanager
def few_rows(spark: SparkSession, n: int):
    """Inside, at most n rows go to Python at a time: for steps that run at once on large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def look_up(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join with a stored table of one row per key, whose `weight` counts the rows of `rows` that have it.

    Keys with more than a 512th of the weight, hence at most 512, are joined by
    broadcast; their rows get keys of their own in the shuffle join and so spread.
    A NULL key finds nothing.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    found = [c for c in facts.columns if c not in (key, weight)]
    hot = facts.where(F.col(weight) > max(1000, total // HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), F.struct(*found).alias("_hot"), F.lit(True).alias("_is_hot")
    )
    cold = facts.select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*found).alias("_cold"))
    one = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt: Column = F.when(F.col("_is_hot") | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")).otherwise(0)
    both = one.withColumn("_salt", salt).join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return both.select(*rows.columns, *[F.when(F.col("_is_hot"), F.col("_hot")[c]).otherwise(F.col("_cold")[c]).alias(c) for c in found])


def connected(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), by alternating stars."""
    pairs = space.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}0")
    before, step = None, 0
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        step += 1
        pairs = space.keep(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}{step}")
        space.drop(f"{name}{step - 1}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
