"""How the tokens of two tokenizers line up in a corpus, by external spill counting.

A text S (a space and the text) is cut by tokenizer A and by tokenizer B. Byte
offsets where both cut end a group; every A token and B token whose bytes overlap
are a link. A pair's count is the number of links of the corpus that hold it.

1. Tasks encode texts and spill *runs*: the (pair, document) records of some
   documents, radix-partitioned by the B id, sorted B-major, compressed by
   Zstandard, as rows of a table in the shared folder. A run has a head (each pair
   once, with its count) and a body (documents and times under each pair).
2. A task of a radix partition merges the heads of all runs by a k-way heap merge,
   which counts each pair. B-major order has all pairs of a B id together, so its
   highest count is known when the next B id begins. Then the bodies stream
   through and give each document its part: the links whose pair is the best of
   its B id, and the sum of counts.
3. The parts are added up per document.

A radix partition with many records is spread over several tasks by run; heads,
whose size is bounded by the two vocabularies, go to each of them.

Both tokenizers work on stretches between spaces that follow something other than
white space, since no token crosses such a place. Each task encodes a stretch
once and looks it up afterwards. Where the files given don't allow that (probed
when they are loaded), whole texts take the place of stretches.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelight.llm.shingles import distinct
from wirelight.llm.workspace import Workspace, few_rows

PARTS = 64
SPILL_STRETCHES = 2_000_000  # occurrences of stretches held by a task before it spills
KNOWN_STRETCHES = 400_000  # different stretches a task knows before it forgets them
SEGMENT = 16_000  # characters that are encoded in one call
FAN = 32  # heads merged at a time
SPLIT_BYTES = 64 << 20  # of bodies in one task of a radix partition
ROWS_PER_BATCH = 64  # runs handed to Python at a time
KEY_BITS = np.uint64(24)

_BREAK = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_ODD = re.compile(r"\s | \Z")
_PROBES = ["a  b\n c\td e", "  two\n\n  lines ", "it's 12 naïve (x) ones — 東京 …", "tail \n", "\x1c a\u00a0 b"]


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


@dataclass
class Stretches:
    """Of some stretches, one after the other: counts per stretch, their links, and their groups as text."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray  # B id << 24 | A id
    text: list[bytes]


@dataclass
class Tokenizers:
    """The two tokenizers by the contents of their files, which a broadcast takes to the tasks."""

    a_json: str
    b_model: bytes

    def __getstate__(self):
        return {"a_json": self.a_json, "b_model": self.b_model}

    @cached_property
    def a(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.a_json)
        found.encode_special_tokens = True
        return found

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        of = _byte_of_symbol()
        vocab = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        return [bytes(of.get(c, 0) for c in vocab.get(i, "")) for i in range(max(vocab) + 1)]

    @cached_property
    def b_bytes(self) -> list[bytes]:
        return _piece_bytes(self.b)

    @cached_property
    def labels(self) -> list[str]:
        """Token ids as text with the separator behind them: A's with , and |, then B's with , and ;."""
        return [f"{i}{sep}" for n, seps in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for sep in seps]

    @cached_property
    def splits(self) -> bool:
        """Whether both tokenizers may be given stretches instead of whole texts."""
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            return False
        for text in _PROBES:
            parts = cut(text)
            a = [i for p in parts for i in self.a.encode(" " + p, add_special_tokens=False).ids]
            b = [i for p in parts for i in self.b.encode(p)]
            if a != self.a.encode(" " + text, add_special_tokens=False).ids or b != self.b.encode(text):
                return False
        return True

    def parts(self, text: str) -> list[str]:
        return cut(text) if self.splits else [text]

    def _encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both, and whether both sides' bytes are those of the segment."""
        of_a = [e.ids for e in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        of_b = self.b.encode(segments, num_threads=1)
        for text, a, b in zip(segments, of_a, of_b, strict=True):
            whole = (" " + text).encode()
            yield a, b, b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))

    def align(self, stretches: Sequence[str]) -> Stretches:
        """A stretch is given without the space it begins with. One whose bytes don't come back is not good and has no tokens."""
        groups, held, size = [], [], 0
        for i, text in enumerate(stretches):
            held.append(i)
            size += len(text) + 1
            # a stretch that ends in white space ends its text, so nothing may follow it
            if size >= SEGMENT or not text or text[-1].isspace() or not self.splits:
                groups.append(held)
                held, size = [], 0
        if held:
            groups.append(held)
        good = np.ones(len(stretches), dtype=bool)
        ids_a, ids_b = [], []
        for lot in range(0, len(groups), 64):
            for group, (a, b, same) in zip(groups[lot : lot + 64], self._encode([" ".join(stretches[i] for i in g) for g in groups[lot : lot + 64]]), strict=True):
                if same:
                    ids_a.append(a)
                    ids_b.append(b)
                    continue
                for i, (a_one, b_one, same_one) in zip(group, self._encode([stretches[i] for i in group]), strict=True):
                    good[i] = same_one
                    if same_one:
                        ids_a.append(a_one)
                        ids_b.append(b_one)
        return self._lined_up(stretches, good, _flat(ids_a), _flat(ids_b))

    @cached_property
    def _lengths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes, self.labels))

    def _lined_up(self, stretches: Sequence[str], good: np.ndarray, a: np.ndarray, b: np.ndarray) -> Stretches:
        len_a, len_b, len_label = self._lengths
        sizes = np.array([len(s.encode("utf-8", "surrogatepass")) + 1 for s in stretches], dtype=np.int64)
        ends = np.cumsum(np.where(good, sizes, 0))
        end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        cuts = distinct(np.concatenate([end_a, end_b]))
        in_a, in_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        shared = cuts[(end_a[in_a] == cuts) & (end_b[in_b] == cuts)] if len(cuts) else cuts
        key = np.concatenate([2 * np.searchsorted(shared, end_a), 2 * np.searchsorted(shared, end_b) + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.ones(len(key), dtype=bool)
        last[:-1] = key[1:] != key[:-1]
        label = np.concatenate([2 * a, 2 * (len(len_a) + b)])[order] + last
        text = "".join(map(self.labels.__getitem__, label.tolist())).encode("ascii")

        def per_stretch(ends_of: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(ends_of, ends, side="right"), prepend=0)

        n_a, n_b = per_stretch(end_a), per_stretch(end_b)
        stop = np.concatenate([[0], np.cumsum(len_label[label])])[np.cumsum(n_a + n_b)].tolist()
        start = [0, *stop[:-1]]
        links = (b[in_b].astype(np.uint64) << KEY_BITS) | a[in_a].astype(np.uint64)
        return Stretches(good, n_a, n_b, per_stretch(shared), per_stretch(cuts), links, [text[i:j] for i, j in zip(start, stop, strict=True)])


def cut(text: str) -> list[str]:
    """The stretches of a space and the text, each without the space it begins with."""
    whole = " " + text
    return [p[1:] for p in _BREAK.split(whole)] if _ODD.search(whole) else text.split(" ")


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.array(x, dtype=np.int64) for x in lists]) if lists else np.zeros(0, dtype=np.int64)


def load(a_path: str, b_path: str) -> Tokenizers:
    """Reads the tokenizers' files: A for the `tokenizers` library, B for `sentencepiece`."""
    with open(a_path, encoding="utf-8") as file_a, open(b_path, "rb") as file_b:
        return Tokenizers(json.dumps(json.load(file_a)), file_b.read())


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type that holds them, compressed."""
    most = int(values.max()) if len(values) else 0
    code = next(c for c in "BHIQ" if most < 1 << 8 * np.dtype(c).itemsize)
    return code.encode() + zstandard.compress(values.astype(f"<{np.dtype(code).str[1:]}").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), dtype=np.dtype(chr(data[0])))


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


@dataclass
class _Task:
    """What a task holds until it spills."""

    tokenizers: Tokenizers
    numbers: _Numbers = field(default_factory=_Numbers)
    known: list[Stretches] = field(default_factory=list)
    text: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), dtype=np.int64))
    docs: list[tuple[int, list[int]]] = field(default_factory=list)
    place: int = 0
    held: int = 0

    def learn(self) -> None:
        fresh = list(islice(self.numbers, len(self.text), None))
        if fresh:
            found = self.tokenizers.align(fresh)
            self.known.append(found)
            self.text += found.text
            self.counts = np.concatenate([self.counts, np.stack([found.good, found.n_a, found.n_b, found.n_groups, found.n_links], axis=1)])

    def runs(self, chunk: int) -> Iterator[dict]:
        """The held records as sorted runs, a row per radix partition."""
        if self.docs:
            links = _by_part(np.concatenate([k.links for k in self.known]))
            pairs = distinct(links)
            which = np.searchsorted(pairs, links)
            n_links = self.counts[:, 4]
            begin = np.cumsum(n_links) - n_links
            at = np.concatenate([np.array(parts, dtype=np.int64) for _, parts in self.docs])
            doc = np.repeat(np.array([p for p, _ in self.docs], dtype=np.int64), [len(parts) for _, parts in self.docs])
            reps = n_links[at]
            inner = np.arange(reps.sum(), dtype=np.int64) - np.repeat(np.cumsum(reps) - reps, reps)
            record = np.sort(which[np.repeat(begin[at], reps) + inner] * np.int64(self.place) + np.repeat(doc, reps))
            del inner, doc, at, reps
            first = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]])) if len(record) else record
            times = np.diff(first, append=len(record))
            pair, doc = np.divmod(record[first], np.int64(self.place))
            del record
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
            count, size = np.add.reduceat(times, head) if len(head) else head, np.diff(head, append=len(pair))
            step = _steps(doc)
            step[head] = doc[head]
            keys = pairs[pair[head]]
            bounds = np.searchsorted(keys, np.arange(PARTS + 1, dtype=np.uint64) << np.uint64(48))
            for part in range(PARTS):
                lo, hi = bounds[part], bounds[part + 1]
                if lo == hi:
                    continue
                one = slice(head[lo], head[hi] if hi < len(head) else len(pair))
                yield {
                    "chunk": chunk, "part": part, "keys": pack(_steps(keys[lo:hi] & np.uint64((1 << 48) - 1))), "counts": pack(count[lo:hi]),
                    "sizes": pack(size[lo:hi]), "docs": pack(step[one]), "times": pack(times[one]), "width": self.place,
                }
        self.docs, self.place, self.held = [], 0, 0


def _by_part(links: np.ndarray) -> np.ndarray:
    """Pairs with their radix partition in front: sorted, they are partition by partition and B-major inside."""
    return ((links >> KEY_BITS) % np.uint64(PARTS) << np.uint64(48)) | links


FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUNS = "chunk long, part integer, width long, keys binary, counts binary, sizes binary, docs binary, times binary"


def _spill(tokenizers, schema: pa.Schema, spill: int, known: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, spills = _Task(tokenizers.value), TaskContext.get().partitionId() << 20
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                cuts = [list(map(task.numbers.__getitem__, task.tokenizers.parts(t))) if t else [] for t in texts]
                task.learn()
                for key, one in zip(part.column(0).to_pylist(), cuts, strict=True):
                    sums = task.counts[one].sum(axis=0) if one else np.zeros(5, dtype=np.int64)
                    row = {"id": key, "row": spills << 20 | task.place, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
                    if one and sums[0] == len(one):
                        digest = hashlib.sha256(b"".join(map(task.text.__getitem__, one))[:-1]).hexdigest()
                        row |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums[1:].tolist(), strict=True)) | {"groups_sha256": digest}
                        task.docs.append((task.place, one))
                        task.held += len(one)
                    task.place += 1
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if task.held >= spill or len(task.numbers) > known or task.place > (1 << 20) - 300:
                    for run in task.runs(spills):
                        yield pa.RecordBatch.from_pylist([run], schema=schema)
                    if len(task.numbers) > known:
                        task = _Task(tokenizers.value)
                    spills += 1
        for run in task.runs(spills):
            yield pa.RecordBatch.from_pylist([run], schema=schema)

    return encode


def merge(runs: list[tuple[np.ndarray, np.ndarray]], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """K-way heap merge of sorted (keys, counts): each key once with the sum of its counts.

    The heap holds the last key of every run's current block. The smallest of them
    bounds what is complete: all runs give their keys up to it, then the run it
    came from opens its next block.
    """
    runs = [r for r in runs if len(r[0])]
    if len(runs) < 2:
        return runs[0] if runs else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    given, ends = [0] * len(runs), [min(block, len(k)) for k, _ in runs]
    heap = [(int(k[e - 1]), i) for i, ((k, _), e) in enumerate(zip(runs, ends, strict=True))]
    heapq.heapify(heap)
    keys, counts = [], []
    while heap:
        bound, i = heap[0]
        some_k, some_c = [], []
        for j, (k, c) in enumerate(runs):
            stop = given[j] + int(np.searchsorted(k[given[j] : ends[j]], np.uint64(bound), side="right"))
            if stop > given[j]:
                some_k.append(k[given[j] : stop])
                some_c.append(c[given[j] : stop])
                given[j] = stop
        every = np.concatenate(some_k)
        found = distinct(every)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, np.searchsorted(found, every), np.concatenate(some_c).astype(np.int64))
        keys.append(found)
        counts.append(total)
        while heap and heap[0][0] <= bound:
            _, i = heapq.heappop(heap)
            if ends[i] < len(runs[i][0]):
                ends[i] = min(ends[i] + block, len(runs[i][0]))
                heapq.heappush(heap, (int(runs[i][0][ends[i] - 1]), i))
    return np.concatenate(keys), np.concatenate(counts)


def best_of_side(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs of a B-major order have their B id's highest count."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    side = keys >> KEY_BITS
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(side)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (place, kind): the heads of a place are merged, then its bodies give the documents' parts."""
    place, heads, total = None, [], None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["place"] != place:
                place, heads, total = row["place"], [], None
            if row["kind"] == 0:
                heads.append((_keys(row["keys"]), unpack(row["counts"]).astype(np.int64)))
                if len(heads) == FAN:
                    heads = [merge(heads)]
                continue
            if total is None:
                keys, counts = merge(heads)
                heads, total = [], (keys, counts, best_of_side(keys, counts))
            at = np.searchsorted(total[0], _keys(row["keys"]))
            sizes = unpack(row["sizes"]).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            doc = np.cumsum(unpack(row["docs"]).astype(np.int64))
            doc -= np.repeat(doc[first] - unpack(row["docs"])[first].astype(np.int64), sizes)
            times = unpack(row["times"]).astype(np.int64)
            best, sums = np.zeros(row["width"], dtype=np.int64), np.zeros(row["width"], dtype=np.int64)
            np.add.at(sums, doc, times * np.repeat(total[1][at], sizes))
            np.add.at(best, doc, times * np.repeat(total[2][at], sizes))
            out.append((row["chunk"], pack(best), pack(sums)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "best", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk: the parts of its documents, added up."""
    chunk, best, sums = None, None, None

    def done() -> pa.RecordBatch:
        row = (np.int64(chunk) << np.int64(20)) + np.arange(len(best), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(best), pa.array(sums)], names=["_row", "n_best", "count_sum"])

    for batch in batches:
        for key, b, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            b, s = unpack(b).astype(np.int64), unpack(s).astype(np.int64)
            if key == chunk:
                best += b
                sums += s
                continue
            if chunk is not None:
                yield done()
            chunk, best, sums = key, b, s
    if chunk is not None:
        yield done()


def align_tokens(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text",
                 spill: int = SPILL_STRETCHES, known: int = KNOWN_STRETCHES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    NULL and empty texts, and texts whose bytes one of the tokenizers doesn't give
    back, have zeros, no digest and no links that count. Equal rows are counted as
    often as they are there, and NULL ids are kept. Ties for a B id's highest count
    all count as best. Invalid UTF-8 is replaced first. Other columns are neither
    read nor returned, whatever their names. `spill` and `known` bound what a task
    holds, `split_bytes` the records of a radix partition in one task; none of them
    changes the result.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType())])
    for part in (*FACTS.split(", "), *RUNS.split(", ")):
        schema.add(*part.split(" "))
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(id_col).alias("_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("_text"))
    spilled = rows.mapInArrow(_spill(spark.sparkContext.broadcast(tokenizers), to_arrow_schema(schema), spill, known), schema)
    table = space.keep(spilled, "runs")
    runs = table.where("part IS NOT NULL")
    # one row per radix partition, of which there is a fixed number
    tasks = {r.part: 1 + r.size // split_bytes for r in runs.groupBy("part").agg(F.sum(F.length("docs") + F.length("times")).alias("size")).collect()}
    shares = F.create_map(*[F.lit(x) for p, n in (tasks or {0: 1}).items() for x in (p, int(n))])[F.col("part")]
    spread = runs.withColumn("share", shares)
    heads = spread.select(F.lit(0).alias("kind"), "part", F.explode(F.sequence(F.lit(0), F.col("share").cast("int") - 1)).alias("task"), "chunk", "keys", "counts")
    bodies = spread.select(F.lit(1).alias("kind"), "part", F.pmod(F.hash("chunk"), F.col("share").cast("int")).alias("task"), "chunk", "width", "keys", "sizes", "docs", "times")
    both = heads.unionByName(bodies, allowMissingColumns=True).withColumn("place", F.col("part") + PARTS * F.col("task")).drop("part", "task")
    with few_rows(spark, ROWS_PER_BATCH):
        counted = both.repartition("place").sortWithinPartitions("place", "kind").mapInArrow(_count, "chunk long, best binary, sums binary")
        parts = space.keep(counted, "parts")
    sums = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add_up, "_row long, n_best long, count_sum long")
    facts = table.where("part IS NULL").select(F.col("id").alias(id_col), F.col("row").alias("_fact"), *[p.split(" ")[0] for p in FACTS.split(", ")])
    joined = facts.join(sums, F.col("_fact") == F.col("_row"), "left")
    none = F.lit(0).cast("long")
    return joined.select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
