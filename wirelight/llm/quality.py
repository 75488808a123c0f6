"""Quality scores by naive Bayes support vectors.

A text's features are indicators of n-grams: words (one and two), and shapes of
words (one to three), where a shape is the word's runs of capitals, small
letters, digits and marks, or "as before" for a repeated word. Indicators are
hashed into a fixed number of cells.

1. Over all labelled training rows, the cells are counted per class; their
   log-count ratios scale the indicators.
2. A linear hinge-loss model is fitted on the scaled indicators by dual
   coordinate descent, on at most `sample` labelled rows (those with the smallest
   hash of their id), its weights mixed with their mean as the method has it.
3. The margin becomes a score by a logistic curve fitted on the same rows.
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

from wirelight.llm.shingles import CHUNK, DOWN, UP, _powers, distinct, mix, sequence_numbers, word_bounds
from wirelight.llm.workspace import Workspace

CELLS = 1 << 18
CELL_ROWS = 16
SAMPLE = 6000
BROADCAST_LABELS = 2_000_000

KIND = np.zeros(256, dtype=np.uint8)
KIND[:] = np.arange(256)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 65, 97, 48, 97
KIND_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C55))
AGAIN = np.uint64(0x5851F42D4C957F2D)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (UP, DOWN) if n <= CHUNK else (_powers(0x9E3779B97F4A7C55, n), _powers(pow(0x9E3779B97F4A7C55, -1, 1 << 64), n))


def _words_and_shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data)
    n = len(data)
    up, down = _powers_for(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    kind = KIND[data]
    run = np.ones(n, dtype=bool)
    run[1:] = kind[1:] != kind[:-1]
    at = np.cumsum(run)
    np.cumsum(np.where(run, KIND_VALUES[kind] * up[at], np.uint64(0)), out=sums[1:])
    shapes = mix((sums[ends] - sums[starts]) * down[at[starts]])
    return starts, words, shapes


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct cells."""
    held, room = [], CHUNK
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and len(data) + 1 > room:
            yield from _cells(held)
            held, room = [], CHUNK
        held.append(data)
        room -= len(data) + 1
    if held:
        yield from _cells(held)


def _cells(held: list[bytes]) -> Iterator[np.ndarray]:
    starts, words, shapes = _words_and_shapes(np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8))
    first = 0
    for cut in np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held])):
        word, shape = words[first:cut], shapes[first:cut].copy()
        first = cut
        shape[1:][word[1:] == word[:-1]] = AGAIN
        grams = [word, sequence_numbers(word, 2), *(sequence_numbers(shape, k) for k in (1, 2, 3))]
        yield distinct(np.concatenate([mix(g + np.uint64(i)) % np.uint64(CELLS) for i, g in enumerate(grams)])).astype(np.int32)


@dataclass
class Model:
    """Score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights over a text's cells / the norm of its ratios."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    shift: float

    def margin(self, cells: np.ndarray) -> float:
        return float(self.weights[cells].sum() / np.sqrt(self.squares[cells].sum() + 1e-12)) if len(cells) else 0.0

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cells) + self.shift, -700, 700))))


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 15, mixed: float = 0.75) -> Model:
    """Dual coordinate descent for the hinge loss on rows of unit length; classes weigh the same."""
    squares = (ratios**2).astype(np.float32)
    weights, rng = np.zeros(len(ratios)), np.random.default_rng(7)
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    most = cost * len(y) / 2 / share[(y > 0).astype(int)]
    norm = np.array([np.sqrt(squares[c].sum() + 1e-12) if len(c) else np.float32(1) for c in rows])

    def row(i: int) -> np.ndarray:
        """A row's scaled indicators, worked out when they are needed: the sample is held as cells only."""
        return ratios[rows[i]] / norm[i]

    length = np.array([float(v @ v) for v in map(row, range(len(rows)))])
    dual = np.zeros(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            if length[i] <= 0:
                continue
            x = row(i)
            slack = y[i] * (weights[rows[i]] @ x) - 1
            new = min(max(dual[i] - slack / length[i], 0.0), most[i])
            if new != dual[i]:
                weights[rows[i]] += (new - dual[i]) * y[i] * x
                dual[i] = new
    weights = mixed * weights + (1 - mixed) * np.abs(weights).mean() * np.sign(ratios) * (ratios != 0)
    model = Model((weights * ratios).astype(np.float32), squares, 1.0, 0.0)
    model.slope, model.shift = _logistic(np.array([model.margin(c) for c in rows]), labels.astype(float))
    return model


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (label - p) - 1e-3 * at
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, CELLS), dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            labels = part.column(1).to_pylist()
            for cells, label in zip(features(part.column(0).to_pylist()), labels, strict=True):
                total[label, cells] += 1
    if total.any():
        parts = total.reshape(2, CELL_ROWS, -1)
        keys = [(c, r) for c in range(2) for r in range(CELL_ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([parts[k].tobytes() for k in keys], pa.binary())], names=["label", "cell_row", "counts"])


def _sum(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum((np.frombuffer(c, dtype=np.int64) for c in rows["counts"]), np.int64(0))
    return pd.DataFrame({"label": [key[0]], "cell_row": [key[1]], "counts": [total.tobytes()]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on all rows of `docs` with a label 0 or 1 in `labels` (joined by id; of several labels of an id the largest counts).

    Without rows of both classes every score is the share of label 1, or a half.
    """
    space = Workspace(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    marks = space.keep(marks, "labels")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    known = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(marks, F.col("_doc") == F.col("_id"))
    schema = "label int, cell_row int, counts binary"
    counted = space.keep(known.select("_text", "_label").mapInArrow(_count, schema), "counts")
    some = counted.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32))).groupBy("label", "cell_row", "part").applyInPandas(_sum, schema)
    total = np.zeros((2, CELL_ROWS, CELLS // CELL_ROWS))
    for row in some.groupBy("label", "cell_row").applyInPandas(_sum, schema).toLocalIterator():
        total[row.label, row.cell_row] = np.frombuffer(row.counts, dtype=np.int64)
    each = total.reshape(2, CELLS) + 1.0
    ratios = np.log(each[1] / each[1].sum()) - np.log(each[0] / each[0].sum())
    ratios[total.reshape(2, CELLS).sum(axis=0) == 0] = 0.0

    # The bound is of labels that have a document here; only ids are read for it.
    usable = docs.select(F.col(id_col).alias("_doc")).join(marks, F.col("_doc") == F.col("_id")).select("_id", "_label").distinct()
    picked = F.broadcast(usable.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    chosen = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(picked, F.col("_doc") == F.col("_id"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c.tobytes() for c in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["id", "cells", "label"])

    kind = docs.schema[id_col].dataType
    found = chosen.select("_doc", "_text", "_label").mapInArrow(cells, T.StructType([T.StructField("id", kind), T.StructField("cells", T.BinaryType()), T.StructField("label", T.IntegerType())]))
    rows = found.orderBy(F.xxhash64("id"), "id", "cells").limit(sample).collect()
    space.close()
    y = np.array([r.label for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model(np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32), 1.0, float(np.log(share / (1 - share))))
    return fit([np.frombuffer(r.cells, dtype=np.int32) for r in rows], y, ratios)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column of scores from 0 to 1; NULL and blank texts have no features and get the curve's value at 0.

    A column of that name is replaced; any other columns stay.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model_.value.score(c) for at in range(0, len(texts), 2000) for c in features(texts.iloc[at : at + 2000].tolist())], dtype="float64")

    return docs.withColumn(score_col, of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; a NULL id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
