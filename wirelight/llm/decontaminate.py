"""Benchmark passages in documents, found by greedy string tiling.

Shared runs of `seed` words, found by Karp-Rabin numbers, join documents to
benchmark items. For each such pair the longest match of unmarked words is marked
as a tile, again and again until none of `seed` words is left. Tiles may stand
in any order, so reordered passages count. An item has leaked into a document
when tiles cover at least `percent` of its words.

The benchmark is sent to the executors in blocks of bounded size, each against
all documents.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelight.llm.shingles import CHUNK, _split, sequence_numbers

SEED = 5
PERCENT = 50
BLOCK_BYTES = 16 << 20
FILTER = 1 << 20
# Marks of ASCII and control characters part words.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(texts: list[str | None]):
    """Each text's words as numbers: lower-cased, parted by anything but letters, digits and non-ASCII characters."""
    held, room = [], CHUNK
    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN)
        if held and len(data) + 1 > room:
            yield from _split(held)
            held, room = [], CHUNK
        held.append(data)
        room -= len(data) + 1
    if held:
        yield from _split(held)


def tiles(item: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, length) from the places of equal seeds; longest first, then earliest."""
    shift = at_doc - at_item
    by = np.lexsort((at_item, shift))
    i, d = at_item[by], shift[by]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(by)]
    heap = [(-(int(b - a) + seed - 1), int(i[a]), int(i[a] + d[a])) for a, b in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), dtype=bool), set(), []
    while heap:
        length, x, y = heapq.heappop(heap)
        free = [not used_item[x + k] and (y + k) not in used_doc for k in range(-length)]
        if all(free):
            used_item[x : x - length] = True
            used_doc.update(range(y, y - length))
            out.append((x, y, -length))
            continue
        k = 0
        while k < len(free):
            run = k
            while run < len(free) and free[run]:
                run += 1
            if run - k >= seed:
                heapq.heappush(heap, (-(run - k), x + k, y + k))
            k = run + 1
    return out


class Benchmark:
    """Items with the seeds of their words."""

    def __init__(self, texts: list[str | None], seed: int) -> None:
        self.seed, self.items = seed, list(words(texts))
        runs = [sequence_numbers(w, seed) for w in self.items]
        number = np.concatenate(runs) if runs else np.zeros(0, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        self.place = np.concatenate([np.arange(len(r)) for r in runs]) if runs else np.zeros(0, dtype=np.int64)
        by = np.argsort(number, kind="stable")
        self.number, self.owner, self.place = number[by], self.owner[by], self.place[by]
        self.filter = np.zeros(FILTER, dtype=bool)
        self.filter[(self.number & np.uint64(FILTER - 1)).astype(np.int64)] = True

    def leaks(self, doc: np.ndarray, percent: int) -> list[int]:
        """Of each leaked item: its index, tiles, words covered and words, one after the other."""
        runs = sequence_numbers(doc, self.seed)
        near = np.flatnonzero(self.filter[(runs & np.uint64(FILTER - 1)).astype(np.int64)])
        if not len(near):
            return []
        lo, hi = np.searchsorted(self.number, runs[near], "left"), np.searchsorted(self.number, runs[near], "right")
        many = hi - lo
        if not many.any():
            return []
        hit = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at_doc, owner, place = np.repeat(near, many), self.owner[hit], self.place[hit]
        out: list[int] = []
        for item in np.unique(owner):
            mine = owner == item
            size = len(self.items[item])
            if 100 * min(size, int(np.unique(place[mine]).size) * self.seed) < percent * size:
                continue
            found = tiles(self.items[item], place[mine], at_doc[mine], self.seed)
            covered = sum(t[2] for t in found)
            if 100 * covered >= percent * size:
                out += [int(item), len(found), covered, size]
        return out


def load_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[list]:
    """The items (id, text) in blocks of about `block_bytes`, one block after the other."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // block_bytes
    for b in range(count):
        yield rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b).orderBy("id", "text").collect()


def leak_columns(benchmark: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text", seed: int = SEED, percent: int = PERCENT) -> list[tuple[Column, list]]:
    """For each block of the benchmark, a column of the leaks (four numbers each) and the ids of its items."""
    return [
        (_leaks_of(benchmark.sparkSession.sparkContext.broadcast(Benchmark([r.text for r in rows], seed)), percent)(F.coalesce(text.cast("string"), F.lit(""))), [r.id for r in rows])
        for rows in load_blocks(benchmark, id_col, text_col)
    ]


def _leaks_of(shared, percent: int):
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        held = shared.value
        return pd.Series([held.leaks(doc, percent) for at in range(0, len(texts), 2000) for doc in words(texts.iloc[at : at + 2000].tolist())], dtype=object)

    return of


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED, percent: int = PERCENT) -> DataFrame:
    """(id, item id, n_tiles, n_covered, n_words): one row per document and leaked item.

    NULL and blank texts, and items of fewer than `seed` words, match nothing.
    Repeated rows each count. Equal tiles go by length, then place in the item,
    then in the document. Without documents or items there are no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType.simpleString()
    parts = []
    for leaks, ids in leak_columns(benchmark, F.col(text_col), item_col, item_text, seed, percent):
        names = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"_i long, _item {kind}"))
        each = docs.select(F.col(id_col).alias("_doc"), leaks.alias("_l")).where("size(_l) > 0").selectExpr("_doc", "explode(sequence(0, size(_l) - 4, 4)) AS _at", "_l")
        rows = each.selectExpr("_doc", "_l[_at] AS _i", "_l[_at + 1] AS n_tiles", "_l[_at + 2] AS n_covered", "_l[_at + 3] AS n_words").join(names, "_i")
        parts.append(rows.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "n_tiles", "n_covered", "n_words"))
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **given) -> DataFrame:
    """`docs` without the documents into which an item has leaked."""
    for leaks, _ in leak_columns(benchmark, F.col(text_col), **given):
        docs = docs.withColumn("_leaks", leaks).where("size(_leaks) = 0").drop("_leaks")
    return docs
