"""Texts of an Arrow batch as flat arrays: words, hashes and windows without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_SEED = np.uint64(0x9E3779B97F4A7C15)
_WORD_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Texts:
    """Consecutive texts of a batch: rows ``first`` to ``first + len(offsets) - 1``, bytes, and the words in them.

    ``words`` has the index of each text's first word (and the end), ``starts`` and ``ends`` the words' bytes.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows with at most ``limit`` bytes, or one longer text."""
    data, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of texts with the byte spans of their words; words are maximal runs of bytes that are not white space."""
    for first, data, offsets in pieces(column, limit):
        inside = ~WHITE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[edges] = inside[edges]
        closes[edges[1:] - 1] = inside[edges[1:] - 1]
        starts = np.flatnonzero(opens)
        yield Texts(first, data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they stand.

    Each value is mixed with its place in the span before the sum, so values with a pattern don't cancel. Work and memory follow the
    spans' total length: for windows that overlap take ``window_hashes``.
    """
    size = ends - starts
    upto = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
    salt = mix(np.arange(size.max(initial=0), dtype=np.uint64) + np.uint64(seed))
    sums = np.zeros(upto[-1] + 1, np.uint64)
    np.cumsum(mix(values[np.repeat(starts, size) + place] ^ salt[place]), out=sums[1:])
    return mix(sums[upto[1:]] - sums[upto[:-1]] + size.astype(np.uint64))


def word_hashes(t: Texts, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(t.starts), np.uint64)
    word = 0
    while word < len(out):  # runs of words of bounded bytes keep the arrays short
        end = max(word + 1, int(np.searchsorted(t.ends, t.starts[word] + CHUNK_BYTES, "right")))
        lo, hi = t.starts[word], t.ends[end - 1]
        data = t.data[lo:hi]
        data = (LOWER[data] if lower else data).astype(np.uint64)
        out[word:end] = span_hashes(data, t.starts[word:end] - lo, t.ends[word:end] - lo, 1)
        word = end
    return out


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive values, from hashes of runs of 1, 2, 4 and so on."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole, covered, run, width = np.full(n, size, np.uint64), 0, mix(values ^ _SEED), 1
    while covered < size:
        if size & width:
            whole = mix(whole * _SEED + run[covered : covered + n])
            covered += width
        if covered < size:
            run = mix(run[:-width] * _WORD_SEED + run[width:])
            width *= 2
    return whole
