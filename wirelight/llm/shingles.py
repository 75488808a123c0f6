"""Word shingles of whole texts as 64-bit numbers, worked out with numpy inside a task.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word's number is a
polynomial of its bytes modulo 2**64, mixed; a shingle's number is a mixed
polynomial of the numbers of its words. Two different shingles of a table share
a number with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
UP, DOWN = _powers(BASE, CHUNK), _powers(INVERSE, CHUNK)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~WHITE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and numbers of the words of a byte array."""
    starts, ends = word_bounds(data)
    n = len(data)
    up, down = (UP, DOWN) if n <= CHUNK else (_powers(BASE, n), _powers(INVERSE, n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def word_numbers(text: str | None) -> np.ndarray:
    """One unsigned 64-bit number per word of the lower-cased text, in order."""
    data = np.frombuffer(_bytes(text), dtype=np.uint8)
    return _numbers(data)[1] if len(data) else np.zeros(0, dtype=np.uint64)


def sequence_numbers(words: np.ndarray, size: int) -> np.ndarray:
    """One number per run of `size` consecutive words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(BASE)
        out += words[i : i + n]
    return mix(out)


def word_arrays(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The word numbers of each text, several short texts at a time."""
    held: list[bytes] = []
    room = CHUNK
    for text in texts:
        data = _bytes(text)
        if held and len(data) + 1 > room:
            yield from _split(held)
            held, room = [], CHUNK
        held.append(data)
        room -= len(data) + 1
    if held:
        yield from _split(held)


def _split(held: list[bytes]) -> Iterator[np.ndarray]:
    starts, numbers = _numbers(np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8))
    cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
    first = 0
    for cut in cuts:
        yield numbers[first:cut]
        first = cut


def distinct(numbers: np.ndarray) -> np.ndarray:
    out = np.sort(numbers)
    if len(out) > 1:
        keep = np.empty(len(out), dtype=bool)
        keep[0] = True
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        out = out[keep]
    return out


def shingle_sets(texts: Sequence[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles; a shorter text is one shingle, no words give none."""
    for words in word_arrays(texts):
        yield distinct(sequence_numbers(words, min(size, len(words)))) if len(words) else words


def set_number(shingles: np.ndarray) -> int:
    """A signed 64-bit number of a whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(INVERSE)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(shingles + place)) + np.uint64(len(shingles))]))[0].view(np.int64))
