"""Centroid clustering against whole-number arithmetic on plain lists."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from compare import connect, differences
from wirelight.llm import oracles, queries, table_kmeans

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def brute(rows, dims=64, k=40, rounds=5):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m)), c) for c, m in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(middle)):
            mine = [v for (_, v), (_, n) in zip(kept, near) if n == c]
            if mine:
                middle[c] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign()
    inertia = {c: sum(d for d, n in near if n == c) for _, c in near}

    def long(x):
        return x if x < 1 << 63 else None

    return sorted(
        ((i, c, long(d), long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)),
        key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    out = table_kmeans.cluster_vectors(table, **options)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n, dims, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(middles)] for _ in range(n)]


def test_equals_plain_arithmetic(spark):
    rows = list(enumerate(vectors(300, 64)))
    rows += [(900 + i, [0.5] * 64) for i in range(60)]  # equal rows, and ties
    rows += [(7, [0.25] * 64), (7, [0.25] * 64), (None, [0.125] * 64)]
    rows += [(990, None), (991, []), (992, [1.0] * 63), (993, [1.0] * 65), (994, [None] + [1.0] * 63), (995, [NAN] + [1.0] * 63), (996, [INF] + [1.0] * 63)]
    assert found(spark, rows, block=64) == brute(rows)


def test_negative_components_are_floored(spark):
    rows = [(i, [-(i + 1) / 300, i / 700, -1 / 512]) for i in range(50)]
    assert found(spark, rows, dims=3, k=4, block=7) == brute(rows, dims=3, k=4)


def test_very_large_components(spark):
    rows = [(i, [float(i), -1e6 * i]) for i in range(30)] + [(50, [1e300, 1.0]), (51, [-1.7e308, 3.0]), (52, [2.0**40, 0.5]), (53, [5e8, 0.25])]
    assert found(spark, rows, dims=2, k=5, block=8) == brute(rows, dims=2, k=5)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = list(enumerate(vectors(11, 64, 2)))
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [1.0])]) == []


def test_wide_vectors(spark):
    rows = list(enumerate(vectors(20, 3000, 3)))
    assert found(spark, rows, dims=3000, k=3, rounds=2) == brute(rows, dims=3000, k=3, rounds=2)


def test_tables_hold_occurring_values_only():
    numbers = np.array([[5, -2], [5, 9], [100_000, -2]])
    wide, narrow, begin, codes = table_kmeans.encode(numbers)
    values, starts, code = table_kmeans.decode(wide, narrow, begin, codes, 3)
    assert values.tolist() == [5, 100_000, -2, 9] and starts.tolist() == [0, 2, 4]
    assert (values[code] == numbers).all()
    assert table_kmeans.tabulate(values, starts, [[0, 1], [5, 9]]).tolist() == [[25, 0], [10**10, 99_995**2], [9, 121], [64, 0]]


@pytest.mark.parametrize("number", [0, 5, -7, 1 << 62, -(1 << 80) - 3, 10**300])
def test_limbs_give_the_number_back(number):
    assert sum(part << table_kmeans.LIMB * place for place, part in enumerate(table_kmeans.limbs(number))) == number


def test_query_equals_its_sql(spark, sf_dir):
    assert differences(queries.vector_clusters(spark, sf_dir), connect(sf_dir), oracles.TABLE_KMEANS) == ""
