"""Signature trees: OR-combined bitmaps and size ranges over sets, joined by dual traversal.

A set's bitmap has a power of two of bits, at least 4 for each element, one set for each hash. Bits of x
that y lacks are elements that y lacks, so |x & y| <= |x| - popcount(x and not y). A node holds the OR
of its members' bitmaps, their least and greatest size, and their greatest surplus of elements over bits;
for two nodes no pair of members can share more than
popcount(or1 and or2) + the smaller surplus. Node pairs whose sizes or whose bound rule a link
out are left; what remains at the leaves is tested member by member, with the same bound.
"""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 8
LEAST_BITS, BITS_EACH, MOST_BITS = 64, 4, 1 << 18


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """uint64 words of the set's bitmap."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(hashes) - 1).bit_length()))
    packed = np.zeros(bits // 8, np.uint8)
    at = (hashes & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return packed.view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """The same set's bitmap in n words."""
    while len(words) > n:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def needed(a, b, percent):
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Tree over sets with bitmaps of one length; `order` puts similar sets near each other."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, percent: int):
        self.order = np.lexsort((*bitmaps.T[:4], sizes // 4))
        self.sizes, self.bitmaps, self.percent = sizes[self.order], bitmaps[self.order], percent
        surplus = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [self._level(self.sizes, self.sizes, self.bitmaps, surplus, LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(*self.levels[-1], FANOUT))

    @staticmethod
    def _level(low, high, bits, surplus, n):
        cut = np.arange(0, len(low), n)
        return (
            np.minimum.reduceat(low, cut),
            np.maximum.reduceat(high, cut),
            np.bitwise_or.reduceat(bits, cut, axis=0),
            np.maximum.reduceat(surplus, cut),
        )

    def _possible(self, level: int, i: int, j: np.ndarray) -> np.ndarray:
        low, high, bits, surplus = self.levels[level]
        most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(most + np.minimum(surplus[i], surplus[j]), np.minimum(high[i], high[j]))
        return most >= needed(low[i], low[j], self.percent)

    def leaf_pairs(self):
        """Pairs of leaves, the first not after the second, that may hold linked members."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                yield i, j
                continue
            n = len(self.levels[level - 1][0])
            for a in range(i * FANOUT, min(n, (i + 1) * FANOUT)):
                b = np.arange(max(a, j * FANOUT), min(n, (j + 1) * FANOUT))
                if len(b):
                    todo += [(level - 1, a, int(x)) for x in b[self._possible(level - 1, a, b)]]

    def candidates(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members (tree positions) of two leaves that pass the bound, each pair once, and the
        similarity that the bound allows."""
        p = np.arange(i * LEAF, min(len(self.sizes), (i + 1) * LEAF))
        q = np.arange(j * LEAF, min(len(self.sizes), (j + 1) * LEAF))
        a, b = self.sizes[p][:, None], self.sizes[q][None, :]
        x, y = self.bitmaps[p][:, None, :], self.bitmaps[q][None, :, :]
        lacks_x = np.bitwise_count(x & ~y).sum(axis=2, dtype=np.int64)
        lacks_y = np.bitwise_count(y & ~x).sum(axis=2, dtype=np.int64)
        most = np.minimum(a - lacks_x, b - lacks_y)
        good = most >= needed(a, b, self.percent)
        if i == j:
            good &= p[:, None] < q[None, :]
        at = np.nonzero(good)
        return p[at[0]], q[at[1]], (most / (a + b - most))[at]


def size_classes(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int):
    """(positions, tree) for each bitmap length: sets of that length, and those of the next ones that
    are still small enough to be linked with them, folded. Any linked pair is in the class of the shorter bitmap."""
    lengths = np.array([len(b) for b in bitmaps])
    for n in np.unique(lengths):
        own = lengths == n
        reach = sizes[own].max() * 100 // percent
        members = np.nonzero(own | ((lengths > n) & (sizes <= reach)))[0]
        if len(members) > 1:
            stacked = np.stack([folded(bitmaps[m], n) for m in members])
            yield members, SignatureTree(sizes[members], stacked, percent)


def similar_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], apart: np.ndarray, percent: int):
    """Positions a, b of pairs that pass the bound and differ in `apart`, and the similarity allowed."""
    for members, tree in size_classes(sizes, bitmaps, percent):
        where = members[tree.order]
        for i, j in tree.leaf_pairs():
            a, b, most = tree.candidates(i, j)
            a, b = where[a], where[b]
            differ = apart[a] != apart[b]
            if differ.any():
                yield a[differ], b[differ], most[differ]
