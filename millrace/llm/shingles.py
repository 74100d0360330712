"""Sets of word shingles as sorted 64-bit hashes, computed on whole Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 21
_SPACE = (32, 9, 10, 11, 12, 13)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the well-known splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTES = _stream(256, 1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = _stream(64, 2) | np.uint64(1)


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of words of each text."""
    base = offsets[0]
    b = data[base : offsets[-1]]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_SPACE[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1] - base
    begins = begins[begins < len(b)]
    first[begins] = inside[begins]  # a text's first byte begins a word though the last text may end with one
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    cuts = np.searchsorted(at, starts)
    lengths = np.diff(np.append(cuts, len(at)))
    rel = np.arange(len(at)) - np.repeat(cuts, lengths)
    hashes = np.add.reduceat(_BYTES[b[at]] * _powers(int(lengths.max()))[rel], cuts)
    counts = np.diff(np.searchsorted(starts, offsets - base))
    return mix(hashes + lengths.astype(np.uint64)), counts


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, its whole sequence is the one shingle."""
    data, offsets = _text_buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1))
        w, counts = word_hashes(data, offsets[i : j + 1])
        ends = np.cumsum(counts)
        m = max(0, len(w) - size + 1)
        grams = np.zeros(m, np.uint64)
        for k in range(size):
            grams += w[k : k + m] * _SLOTS[k]
        grams = mix(grams)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= size:
                yield np.unique(grams[end - count : end - size + 1])
            elif count:
                short = (w[end - count : end] * _SLOTS[:count]).sum(keepdims=True) + np.array([count], np.uint64) * _SLOTS[63:]
                yield mix(short)
            else:
                yield np.zeros(0, np.uint64)
        i = j


class MinHash:
    """Minwise hashing with ``n`` functions of the form a * x + b over already mixed 64-bit values."""

    def __init__(self, n: int, seed: int = 3) -> None:
        self.a, self.b = _stream(n, seed) | np.uint64(1), _stream(n, seed + 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 1024):
            x = hashes[i : i + 1024, None] * self.a
            x += self.b
            np.minimum(low, x.min(0), out=low)
        return mix(low)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for sorted distinct values."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)
