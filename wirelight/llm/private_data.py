"""Personal data in texts: patterns, and a bidirectional LSTM with CRF transitions.

The four patterns give the base spans. A character tagger is trained in numpy on
the labelled spans of a bounded sample of windows and adds spans the patterns
miss. Its windows overlap and lie wherever a text has a digit or an at sign, on
whose sides all four kinds lie, so every place that can hold a span is decoded. A
character takes its label from the window in which it lies farthest from an edge.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN = 16
SAMPLE = 1500
BATCH = 4096

# The patterns of the base spans. Anchors keep them linear on long runs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and non-overlapping per kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _codes() -> np.ndarray:
    """Character classes: small and capital letters, digits, space, line end, each ASCII mark, and all else."""
    codes = np.full(129, 5, dtype=np.int64)
    marks = 6
    for c in range(128):
        x = chr(c)
        if x.isalpha():
            codes[c] = 2 if x.isupper() else 1
        elif x.isdigit():
            codes[c] = 3
        elif x == " ":
            codes[c] = 4
        elif c > 32 and c < 127:
            codes[c], marks = marks, marks + 1
    codes[128] = 1
    return codes


CODES = _codes()
VOCABULARY = int(CODES.max()) + 1


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CODES[np.minimum(points, 128)]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, with a margin on both sides."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(a: int, b: int) -> list[int]:
    return list(range(a, max(a + 1, b - STRIDE), STRIDE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """One LSTM per direction over character classes, label scores from both, and CRF transitions between labels."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (VOCABULARY, 4 * h))
            w[f"h{d}"] = rng.normal(0, 0.3 / np.sqrt(h) * 2, (h, 4 * h))
            w[f"b{d}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        w["o"], w["ob"] = rng.normal(0, 0.2, (2 * h, LABELS)), np.zeros(LABELS)
        w["t"], w["s"] = np.zeros((LABELS, LABELS)), np.zeros(LABELS)
        return cls(w)

    def _run(self, codes: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [T, B, H] of one direction; `codes` is [T, B] in its order."""
        w, h = self.weights, HIDDEN
        state, cell = np.zeros((codes.shape[1], h)), np.zeros((codes.shape[1], h))
        out, held = np.empty((*codes.shape, h)), []
        for t in range(len(codes)):
            z = w[f"x{d}"][codes[t]] + state @ w[f"h{d}"] + w[f"b{d}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before = cell
            cell = f * cell + i * g
            tanh = np.tanh(cell)
            if keep:
                held.append((i, f, o, g, before, tanh, state))
            state = o * tanh
            out[t] = state
        return out, held

    def scores(self, codes: np.ndarray, keep: bool = False):
        """Label scores [T, B, L] of windows [B, T]."""
        steps = codes.T
        forth, held_f = self._run(steps, "f", keep)
        back, held_b = self._run(steps[::-1], "b", keep)
        both = np.concatenate([forth, back[::-1]], axis=2)
        return both @ self.weights["o"] + self.weights["ob"], (both, held_f, held_b)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labels [B, T] by Viterbi."""
        e, _ = self.scores(codes)
        t, best, back = self.weights["t"], self.weights["s"] + e[0], []
        for x in e[1:]:
            all_ = best[:, :, None] + t[None]
            back.append(all_.argmax(axis=1))
            best = all_.max(axis=1) + x
        label = best.argmax(axis=1)
        out = [label]
        for b in reversed(back):
            label = b[np.arange(len(label)), label]
            out.append(label)
        return np.stack(out[::-1], axis=1)

    def loss(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a window and its gradients."""
        w = self.weights
        e, (both, held_f, held_b) = self.scores(codes, keep=True)
        steps, n = e.shape[0], e.shape[1]
        y, rows = labels.T, np.arange(n)
        alpha = np.empty_like(e)
        alpha[0] = w["s"] + e[0]
        for k in range(1, steps):
            alpha[k] = _log_sum(alpha[k - 1][:, :, None] + w["t"][None], 1) + e[k]
        whole = _log_sum(alpha[-1], 1)
        gold = w["s"][y[0]] + e[0][rows, y[0]]
        for k in range(1, steps):
            gold = gold + w["t"][y[k - 1], y[k]] + e[k][rows, y[k]]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        de, beta = np.empty_like(e), np.zeros((n, LABELS))
        for k in range(steps - 1, -1, -1):
            p = np.exp(alpha[k] + beta - whole[:, None])
            p[rows, y[k]] -= 1
            de[k] = p / n
            if k:
                onto = e[k] + beta
                pair = np.exp(alpha[k - 1][:, :, None] + w["t"][None] + onto[:, None, :] - whole[:, None, None])
                grads["t"] += pair.sum(axis=0) / n
                np.add.at(grads["t"], (y[k - 1], y[k]), -1 / n)
                beta = _log_sum(w["t"][None] + onto[:, None, :], 2)
        grads["s"] = de[0].sum(axis=0)
        grads["ob"] = de.sum(axis=(0, 1))
        grads["o"] = np.einsum("tbh,tbl->hl", both, de)
        dboth = de @ w["o"].T
        steps_codes = codes.T
        self._back(steps_codes, dboth[:, :, :HIDDEN], held_f, "f", grads)
        self._back(steps_codes[::-1], dboth[::-1, :, HIDDEN:], held_b, "b", grads)
        return float((whole - gold).mean()), grads

    def _back(self, codes: np.ndarray, dout: np.ndarray, held: list, d: str, grads: dict) -> None:
        h = HIDDEN
        dstate, dcell = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(codes) - 1, -1, -1):
            i, f, o, g, before, tanh, state = held[t]
            ds = dout[t] + dstate
            dc = dcell + ds * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(grads[f"x{d}"], codes[t], dz)
            grads[f"h{d}"] += state.T @ dz
            grads[f"b{d}"] += dz.sum(axis=0)
            dstate, dcell = dz @ self.weights[f"h{d}"].T, dc * f

    def fit(self, codes: np.ndarray, labels: np.ndarray, steps: int = 160, batch: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over random batches; the last loss."""
        rng, loss = np.random.default_rng(seed), 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), min(batch, len(codes)))
            loss, grads = self.loss(codes[pick], labels[pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            pace = rate * (1 - step / (steps + 1)) + 1e-3
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = self.weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return loss


def mark_labels(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """A label per character: 0 outside, 2k + 1 at the start of a span of kind k, 2k + 2 inside; earlier kinds win."""
    out = np.zeros(len(text), dtype=np.int64)
    for kind, a, b in reversed(spans):
        out[a:b] = 2 * kind + 2
        out[a] = 2 * kind + 1
    return out


def cut(codes: np.ndarray, start: int) -> np.ndarray:
    part = codes[start : start + WINDOW]
    return np.r_[part, np.zeros(WINDOW - len(part), dtype=np.int64)]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Tagger | None:
    """Fits a tagger on at most `sample` windows (those of smallest hash), labelled by the base spans; None without any window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if not text or not TRIGGER.search(text):
                    continue
                codes, labels = encode(text), mark_labels(text, base_spans(text))
                for a, b in regions(text):
                    for start in window_starts(a, b):
                        x, y = cut(codes, start).astype(np.uint8).tobytes(), cut(labels, start).astype(np.uint8).tobytes()
                        out.append((hashlib.md5(x + y).digest(), x, y))
            if out:
                # Only the smallest of a batch can be among the smallest of all.
                out = sorted(set(out))[:sample]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["mark", "codes", "labels"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(windows, "mark binary, codes binary, labels binary")
    rows = found.distinct().orderBy("mark").limit(sample).collect()
    if not rows:
        return None
    codes, labels = (np.stack([np.frombuffer(r[c], dtype=np.uint8) for r in rows]).astype(np.int64) for c in ("codes", "labels"))
    tagger = Tagger.fresh()
    tagger.fit(codes, labels)
    return tagger


def _plausible(kind: int, text: str) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return "@" in text[1:-1] and "." in text.partition("@")[2]
    if kind == 1:
        return len([p for p in re.split(r"[^0-9]+", text) if p]) == 4
    return 13 <= digits <= 19 if kind == 2 else 9 <= digits <= 15


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], tagger: Tagger | None) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text that overlap no base span and have what their kind needs."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return out
    held: list[tuple[int, int, int]] = []
    codes: list[np.ndarray] = []

    def flush() -> None:
        if not held:
            return
        labels = np.concatenate([tagger.decode(np.stack(codes[k : k + BATCH])) for k in range(0, len(codes), BATCH)])
        at = 0
        for i, a, b in held:
            starts = window_starts(a, b)
            label, depth = np.zeros(b - a, dtype=np.int64), np.full(b - a, -1)
            for start in starts:
                end = min(start + WINDOW, b)
                inner = np.minimum(np.arange(start, end) - start + (1000 if start == a else 0), start + WINDOW - 1 - np.arange(start, end) + (1000 if end == b else 0))
                better = inner > depth[start - a : end - a]
                label[start - a : end - a][better] = labels[at][: end - start][better]
                depth[start - a : end - a][better] = inner[better]
                at += 1
            for kind, x, y in _runs(label):
                word = texts[i][a + x : a + y]
                x, y = a + x + len(word) - len(word.lstrip()), a + y - len(word) + len(word.rstrip())
                if x < y and _plausible(kind, texts[i][x:y]) and not any(p < y and x < q for _, p, q in bases[i]):
                    out[i].append((kind, x, y))
        held.clear()
        codes.clear()

    for i, text in enumerate(texts):
        whole = None
        for a, b in regions(text):
            whole = encode(text) if whole is None else whole
            held.append((i, a, b))
            codes.extend(cut(whole, start) for start in window_starts(a, b))
            if len(codes) >= BATCH:
                flush()
    flush()
    return out


def _runs(label: np.ndarray) -> list[tuple[int, int, int]]:
    out, open_ = [], None
    for k, v in enumerate([*label.tolist(), 0]):
        kind = (v - 1) // 2 if v else None
        if open_ and (kind != open_[0] or v % 2 == 1):
            out.append((open_[0], open_[1], k))
            open_ = None
        if v and not open_:
            open_ = (kind, k)
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of `docs`.

    The numbers and the digest are those of the base spans; `spans` has the
    tagger's as well. NULL and empty texts have none; repeated rows and NULL ids
    each give a row; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    names = ["n_email", "n_ip", "n_card", "n_phone"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, held.value)
                counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(render(b).encode()).hexdigest() for b in bases], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([render(b + m) for b, m in zip(bases, more, strict=True)], pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
