"""Slices of a busy group give the chain's answer."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from wirelight.operators import busy_groups
from wirelight.operators.busy_groups import dedup_last8_sliced
from wirelight.operators.dedup import dedup_last8, keep_unlike_recent

SHAPES = {
    "many keys": "xxhash64(id) % 40",
    "about eight keys": "xxhash64(id) % 9",
    "few keys": "xxhash64(id) % 3",
    "one key": "1L",
    "eight keys once, then two of them": "IF(id < 8, id, id % 2)",
    "phases": "xxhash64(id) % (1 + CAST(id / 1500 AS INT) % 12)",
    "with NULL": "IF(id % 5 <> 0, xxhash64(id) % 11, NULL)",
}


def chain(rows):
    fresh = keep_unlike_recent(deque(maxlen=8), [r.q for r in rows])
    return [r.id for r, f in zip(rows, fresh, strict=True) if f]


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("head", [20_000, 50])
def test_one_group_with_all_rows(spark, monkeypatch, shape, head):
    monkeypatch.setattr(busy_groups, "HEAD", head)
    rows = spark.range(12_000).select("id", F.expr(SHAPES[shape]).alias("q"), F.lit("s").alias("sensor"), F.lit(3).alias("_kept"))
    found = dedup_last8_sliced(rows.repartition(5), ["sensor"], ["id"], ["q"], slices=12)
    assert found.columns == rows.columns
    assert sorted(r.id for r in found.collect()) == chain(rows.orderBy("id").collect())


def test_chains_that_stay_open_are_replayed_in_order(spark, monkeypatch):
    monkeypatch.setattr(busy_groups, "ROUNDS", 1)
    rows = spark.range(6_000).select("id", F.expr(SHAPES["eight keys once, then two of them"]).alias("q"), F.lit("s").alias("sensor"))
    assert sorted(r.id for r in dedup_last8_sliced(rows, ["sensor"], ["id"], ["q"], slices=10).collect()) == list(range(8))


def test_groups_within_and_across_slices(spark):
    """One sensor with most rows among many small ones; a NULL sensor is one, too."""
    sensor = F.when(F.col("id") % 3 != 0, "m").when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") % 50).cast("string")))
    rows = spark.range(9_000).select("id", sensor.alias("sensor"), (F.xxhash64("id") % 10).alias("q"), F.struct(F.col("id")).alias("more"))
    sliced = dedup_last8_sliced(rows, ["sensor"], ["id"], ["q"], slices=9)
    whole = dedup_last8(rows, ["sensor"], ["id"], ["q"])
    assert sliced.schema.simpleString() == rows.schema.simpleString()
    assert sorted(r.id for r in sliced.collect()) == sorted(r.id for r in whole.collect())
    assert "_group" not in sliced.columns


def test_no_rows(spark):
    rows = spark.createDataFrame([], "id long, sensor string, q string")
    assert dedup_last8_sliced(rows, ["sensor"], ["id"], ["q"]).count() == 0


def test_a_busy_group_is_spread(spark):
    rows = spark.range(40_000).select("id", (F.xxhash64("id") % 20).alias("q"), F.lit("s").alias("sensor"))
    kept = dedup_last8_sliced(rows, ["sensor"], ["id"], ["q"], slices=8)
    assert kept.select(F.spark_partition_id().alias("p")).distinct().count() > 1
