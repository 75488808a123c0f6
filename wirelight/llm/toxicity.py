"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words and the beginnings (3 to 8 bytes) of longer words,
lower-cased, each counted once and hashed into a fixed number of cells.

1. Over all labelled training rows, texts with each cell are counted per class.
   The cells whose presence depends most on the class (by chi-square) are kept. A
   cell's value in a text is 1, or less in proportion where chi-square is under
   `LEAST`, which holds back cells that depend by chance.
2. A factorization machine is fitted by logistic loss on at most `sample` labelled
   rows (those with the smallest hash of their id): a weight per kept cell plus,
   for each pair of cells in a text, the product of their factor vectors. So a
   pair can weigh more or less than the sum of its terms.
3. A score is the logistic of the machine's output; it is worked out per text in
   time linear in its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.llm.shingles import BYTE_VALUES, CHUNK, DOWN, UP, BASE, INVERSE, _powers, distinct, mix, word_bounds
from wirelight.llm.workspace import Workspace

CELLS = 1 << 20
SHELVES = 64  # rows that a task's counts of a class leave it as
BEGINNINGS = range(3, 9)
SAMPLE = 10_000
KEPT = 1 << 13
LEAST = 10.83  # chi-square of one in a thousand: from here on a cell counts in full
FACTORS = 8
BROADCAST_BYTES = 128 << 20

#: Letters of any script and digits stay, all else separates words.
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[:128] = [c if chr(c).isalnum() else 0x20 for c in range(128)]


def terms(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct cells."""
    held, room = [], CHUNK
    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if held and len(data) + 1 > room:
            yield from _cells(held)
            held, room = [], CHUNK
        held.append(data)
        room -= len(data) + 1
    if held:
        yield from _cells(held)


def _cells(held: list[bytes]) -> Iterator[np.ndarray]:
    data = CLEAN[np.frombuffer(b" ".join(held) + b" ", dtype=np.uint8)]
    starts, ends = word_bounds(data)
    n = len(data)
    up, down = (UP, DOWN) if n <= CHUNK else (_powers(BASE, n), _powers(INVERSE, n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in held]), starts, side="right")
    found = []
    for size in (0, *BEGINNINGS):
        has = ends - starts > size if size else slice(None)
        first = starts[has]
        last = first + size if size else ends
        cell = mix((sums[last] - sums[first]) * down[first] + np.uint64(size)) % np.uint64(CELLS)
        found.append(text[has].astype(np.int64) * CELLS + cell.astype(np.int64))
    every = distinct(np.concatenate(found))
    cuts = np.searchsorted(every, np.arange(len(held) + 1, dtype=np.int64) * CELLS)
    for i in range(len(held)):
        yield (every[cuts[i] : cuts[i + 1]] % CELLS).astype(np.int32)


@dataclass
class Machine:
    """Score = 1 / (1 + exp(-(bias + sum of weights + sum over pairs of factor products)))."""

    kept: np.ndarray  # cells, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rank(self, cells: np.ndarray) -> np.ndarray:
        """Places of a text's cells among the kept ones."""
        if not len(self.kept):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.kept, cells), len(self.kept) - 1)
        return at[self.kept[at] == cells]

    def output(self, rank: np.ndarray) -> float:
        v = self.factors[rank]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rank].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, cells: np.ndarray) -> float:
        out = self.output(self.rank(cells))
        return float(out > 0) if np.isinf(out) else float(1 / (1 + np.exp(-np.clip(out, -700, 700))))


def fit(rows: list[np.ndarray], labels: np.ndarray, values: np.ndarray, factors: int = FACTORS, rounds: int = 20, batch: int = 64,
        rate: float = 0.1, shrink: float = 5e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by steps of AdaGrad on the logistic loss.

    `rows` holds the terms of each text and `values` the value of each term, which
    is multiplied into what is returned.
    """
    rng = np.random.default_rng(11)
    n_terms = len(values)
    share = min(max(float(labels.mean()), 1e-4), 1 - 1e-4)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, factors))
    seen_b, seen_w, seen_v = 1e-2, np.full(n_terms, 1e-2), np.full((n_terms, factors), 1e-2)
    sizes = np.array([len(r) for r in rows])
    heavier = np.sqrt((1 - share) / share)
    importance = np.where(labels > 0, max(1.0, heavier), max(1.0, 1 / heavier))
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            term = np.concatenate([rows[i] for i in some])
            text, value = np.repeat(np.arange(len(some)), sizes[some]), values[term]
            factor = v[term] * value[:, None]
            total = np.zeros((len(some), factors))
            np.add.at(total, text, factor)
            squares = np.bincount(text, (factor * factor).sum(axis=1), len(some))
            out = bias + np.bincount(text, w[term] * value, len(some)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[some]
            error *= importance[some]
            seen_b += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / np.sqrt(seen_b)
            used, where = np.unique(term, return_inverse=True)
            pull = error[text] * value
            grad_w = np.bincount(where, pull, len(used)) + shrink * len(some) * w[used]
            grad_v = np.zeros((len(used), factors))
            np.add.at(grad_v, where, pull[:, None] * (total[text] - factor))
            grad_v += shrink * len(some) * v[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            w[used] -= rate * grad_w / np.sqrt(seen_w[used])
            v[used] -= rate * grad_v / np.sqrt(seen_v[used])
    return bias, w * values, v * values[:, None]


def strongest(counts: np.ndarray, sizes: np.ndarray, most: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells of the largest chi-square of presence and class, and their values; `counts` holds texts per class and cell, `sizes` texts per class."""
    n0, n1 = (float(x) for x in sizes)
    a, b = counts[1].astype(float), counts[0].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (n0 + n1) * (a * n0 - b * n1) ** 2 / (n0 * n1 * (a + b) * (n0 + n1 - a - b))
    chi[~np.isfinite(chi)] = 0.0
    fine = np.flatnonzero((chi > 1) & (a + b >= 2))
    kept = np.sort(fine[np.argsort(-chi[fine], kind="stable")[:most]])
    return kept.astype(np.int32), np.minimum(1.0, chi[kept] / LEAST)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros((2, CELLS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            for cells, label in zip(terms(part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True):
                total[label, cells] += 1
                texts[label] += 1
    shelves = total.reshape(2, SHELVES, -1)
    keys = [(c, s) for c in range(2) for s in range(SHELVES) if texts[c]]
    if keys:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([int(texts[k[0]]) for k in keys], pa.int64()), pa.array([shelves[k].tobytes() for k in keys], pa.binary())],
            names=["label", "shelf", "texts", "counts"])


def _sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(c, dtype=np.int64) for c in rows["counts"]), np.int64(0))
    return pd.DataFrame({"label": [key[0]], "shelf": [key[1]], "texts": [rows["texts"].sum()], "counts": [total.tobytes()]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Learns from the rows of `docs` with a label 0 or 1 in `labels`, joined by id.

    Of several labels of an id the largest counts; NULL ids and labels say nothing,
    NULL and empty texts are texts without terms, repeated rows count as often as
    they are there. Where all labelled rows have one label, it is every score, and
    without any labelled row every score is 0.
    """
    space = Workspace(docs.sparkSession)
    marks = space.keep(labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")), "labels")
    # ids and labels in place of texts are moved, as long as their bytes allow it
    size = marks.agg(F.sum(F.octet_length(F.col("_id").cast("string")) + 4)).first()[0] or 0
    marks = F.broadcast(marks) if size <= BROADCAST_BYTES else marks
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    known = texts.join(marks, F.col("_doc") == F.col("_id"))
    schema = "label int, shelf int, texts long, counts binary"
    counted = space.keep(known.select("_text", "_label").mapInArrow(_count, schema), "counts")
    halved = counted.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("label", "shelf", "part").applyInPandas(_sum, schema)
    total, sizes = np.zeros((2, SHELVES, CELLS // SHELVES), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for row in halved.groupBy("label", "shelf").applyInPandas(_sum, schema).toLocalIterator():
        total[row.label, row.shelf] = np.frombuffer(row.counts, dtype=np.int64)
        sizes[row.label] = row.texts
    if not sizes.all():
        space.close()
        return Machine(np.zeros(0, np.int32), np.inf if sizes[1] else -np.inf, np.zeros(0), np.zeros((0, FACTORS)))
    kept, values = strongest(total.reshape(2, CELLS), sizes)
    del total
    machine = docs.sparkSession.sparkContext.broadcast(Machine(kept, 0.0, np.zeros(len(kept)), np.zeros((len(kept), 0))))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [machine.value.rank(c).astype(np.int32).tobytes() for c in terms(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["id", "terms", "label"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("terms", T.BinaryType()), T.StructField("label", T.IntegerType())])
    usable = docs.select(F.col(id_col).alias("_doc")).join(marks, F.col("_doc") == F.col("_id")).select("_id", "_label").distinct()
    picked = space.keep(usable.orderBy(F.xxhash64("_id"), "_id").limit(sample), "picked")
    chosen = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_id", "_text", "_label")
    rows = chosen.mapInArrow(ranks, kind).orderBy(F.xxhash64("id"), "id", "terms").limit(sample).collect()
    machine.unpersist()
    space.close()
    y = np.array([r.label for r in rows], dtype=np.float64)
    bias, weights, factors = fit([np.frombuffer(r.terms, dtype=np.int32) for r in rows], y, values)
    return Machine(kept, bias, weights, factors)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column of scores from 0 to 1.

    NULL and blank texts have no terms and get the logistic of the bias. A column
    of that name is replaced; any other columns and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(c) for lo in range(0, len(texts), 2000) for c in terms(texts.iloc[lo : lo + 2000].tolist())], dtype="float64")

    return docs.withColumn(score_col, of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5; a NULL id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
