"""Word shingles as sets of 64-bit hashes, in numpy on Arrow buffers, for use inside tasks.

A word's hash is a polynomial of a random number for each of its bytes, so the words of many texts
are hashed at once from one cumulative sum, without an object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words per shingle and the similarity from which texts are near duplicates, in percent.
WIDTH, PERCENT = 5, 80

#: Bytes of text that are hashed together; a longer text goes alone.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the offsets of its values in them; NULL is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def find_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK):
    """First and last byte of each word of texts that lie one after the other, and each text's first word."""
    solid = ~blank[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.nonzero(starts)[0], np.nonzero(ends)[0]
    return first, last, np.searchsorted(first, offsets)


class ByteSums:
    """Hashes of any spans of `data`, from one cumulative sum; ASCII letters in lower case."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=self.total[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def hashes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.total[end] - self.total[first]) * self.back[first]
        return _mix(value + (end - first).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other, and each text's first word."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    first, last, at = find_words(data, offsets)
    return ByteSums(data).hashes(first, last + 1), at


def byte_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of about BLOCK_BYTES."""
    data, offsets = spans(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, first words) for runs of texts."""
    for at, data, offsets in byte_blocks(column):
        yield at, *word_hashes(data, offsets)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """At each word the hash of the `width` words from it on, whichever text they are of."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        total += hashes[i : len(hashes) - width + 1 + i] * _FACTORS[i % 64]
    return _mix(total)


def shingle_sets(
    column: pa.Array, width: int = WIDTH, weights: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text the sorted distinct hashes of its shingles, and their weights.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words than
    `width` has one shingle, all its words; without words, or NULL, it has none. `weights` has a
    number for each cell of words (a power of two of cells); a shingle's is the sum over its words.
    """
    shift = np.uint64(64 - len(weights).bit_length() + 1) if weights is not None else None
    for _, hashes, first in blocks(column):
        full = shingles_of(hashes, width)
        heavy = None
        if weights is not None:
            each = np.concatenate([[0], np.cumsum(weights[(hashes >> shift).astype(np.int64)])])
            heavy = (each[width:] - each[:-width])[: len(full)]
        for start, end in zip(first, first[1:]):
            if end - start >= width:
                own = full[start : end - width + 1]
                order = np.argsort(own) if heavy is not None else None
                own = own[order] if heavy is not None else np.sort(own)
                fresh = np.ones(len(own), bool)
                fresh[1:] = own[1:] != own[:-1]
                yield own[fresh], heavy[start : end - width + 1][order][fresh] if heavy is not None else None
            elif end > start:
                own = hashes[start:end] + np.uint64(end - start)  # no shingle of a longer text
                whole = shingles_of(own, end - start)
                yield whole, each[end : end + 1] - each[start] if heavy is not None else None
            else:
                yield np.empty(0, np.uint64), np.empty(0) if heavy is not None else None


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """x and y sorted and distinct."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)
