"""Factorization machine: pairs of terms, whole texts, held-out rows."""

from __future__ import annotations

import random

import numpy as np

from wirelight.llm import queries, toxicity

GROUPS = ["norsemen", "plumbers", "tenants"]
INSULTS = ["vermin", "filth", "parasites"]
PLAIN = [f"{a}{b}" for a in "mar tel sor ving dal pre".split() for b in "ten or ish ung ado lin".split()]


def talk(rng, *kinds):
    words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 40))] + [rng.choice(k) for k in kinds]
    rng.shuffle(words)
    return " ".join(words)


def pair_corpus(n, seed):
    """Toxic only where an insult meets a group; several insults or several groups alone are fine."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = i % 4
        text = talk(rng, *([(INSULTS, GROUPS), (INSULTS,) * 3, (GROUPS,) * 3, ()][kind]))
        out.append((i, text, int(kind == 0)))
    return out


def test_pairs_that_a_sum_of_weights_misses(spark):
    rows = pair_corpus(2400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    fresh = pair_corpus(400, 2)
    cells = list(toxicity.terms([t for _, t, _ in fresh]))
    got = [machine.score(c) >= 0.5 for c in cells]
    right = np.mean([g == bool(y) for g, (_, _, y) in zip(got, fresh)])
    rank = [machine.rank(c) for c in toxicity.terms([t for _, t, _ in rows])]
    flat = toxicity.Machine(machine.kept, *toxicity.fit(rank, np.array([y for *_, y in rows], float), np.ones(len(machine.kept)), factors=0))
    linear = np.mean([(flat.score(c) >= 0.5) == bool(y) for c, (_, _, y) in zip(cells, fresh)])
    assert right > 0.97
    assert linear < right - 0.03


def test_output_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(0, 60, 2, dtype=np.int32), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    cells = np.array([0, 3, 8, 10, 11, 44], dtype=np.int32)
    rank = [0, 4, 5, 22]
    assert machine.rank(cells).tolist() == rank
    plain = 0.3 + sum(machine.weights[i] for i in rank) + sum(machine.factors[i] @ machine.factors[j] for x, i in enumerate(rank) for j in rank[x + 1 :])
    assert abs(machine.output(machine.rank(cells)) - plain) < 1e-9


def test_terms_do_not_depend_on_their_neighbours():
    texts = ["One tWo, two!", None, "", "straße ÉTÉ", "x" * 400_000, "one", "%%% --"]
    alone = [list(next(iter(toxicity.terms([t])))) for t in texts]
    assert [list(c) for c in toxicity.terms(texts)] == alone
    assert list(next(iter(toxicity.terms(["one two"])))) == alone[0]
    assert list(next(iter(toxicity.terms(["été straße"])))) == alone[3]
    assert alone[1] == alone[2] == alone[6] == []
    assert len(alone[4]) == 1 + len(toxicity.BEGINNINGS)


def test_long_texts_count_to_their_end(spark):
    rows = pair_corpus(800, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    rng = random.Random(6)
    filler = " ".join(rng.choice(PLAIN) for _ in range(200_000))
    low, high = (machine.score(next(iter(toxicity.terms([t])))) for t in (filler, filler + " vermin plumbers"))
    assert low < 0.5 < high


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "vermin plumbers", "c"), (3, "vermin plumbers", "c"), (None, "vermin", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score(docs, empty).collect()] == [0.0] * 5
    only = toxicity.train(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, only).collect()] == [1.0] * 5
    both = toxicity.train(docs, spark.createDataFrame([(1, 0), (3, 1), (3, 0)], "doc_id long, toxic int"))
    scored = toxicity.score(docs, both).select("doc_id", "text", "score").collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored) and scored[2] == scored[3]
    assert toxicity.score(docs.limit(0), both).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.toxicity_score(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, fine = ([r.predicted for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert len(held) > 40 and np.mean(toxic) >= 0.6 and np.mean(fine) <= 0.03
