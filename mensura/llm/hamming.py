"""A Gray-order hierarchical index over 64-bit fingerprints, for self joins within a small Hamming distance.

Fingerprints of one bucket are sorted by Gray rank, so that neighbours share most bits. Every FAN neighbours form
a node that keeps the bits all of them share (a mask and their pattern); every FAN nodes form a node above, up to
one root a bucket. The self join starts with the root against itself and goes down: a pair of nodes is dropped with
all below it if the patterns differ in more than the allowed bits where both masks hold. A pair whose fingerprints
are in one component already is dropped as well, so dense buckets cost little more than their links.
"""

from __future__ import annotations

import numpy as np

FAN = 16
PAIRS = 2048  # node pairs opened at once: bounds the memory of one step at PAIRS * FAN ** 2 pairs


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Forest:
    """Components of the leaves, by least leaf."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                return
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(root, high, low)
            while not np.array_equal(step := root[root], root):
                root[:] = step


class Index:
    """Levels of nodes over fingerprints sorted by bucket and Gray rank; level 0 are the fingerprints themselves."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        n = len(prints)
        run = np.zeros(n, np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        self.ands, self.ors, self.first = [prints], [prints], [np.arange(n + 1)]
        owner, begin = run, starts
        while len(begin) < len(owner):
            place = np.arange(len(owner)) - begin[owner]
            heads = np.flatnonzero(place % FAN == 0)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], heads))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], heads))
            self.first.append(np.append(heads, len(owner)))
            owner = owner[heads]
            begin = np.searchsorted(owner, np.arange(len(starts)))
        #: the leaves below each node, as bounds
        self.leaf = [np.arange(n + 1)]
        for heads in self.first[1:]:
            self.leaf.append(self.leaf[-1][heads])

    def near(self, level: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        shared = ~(self.ors[level][a] ^ self.ands[level][a]) & ~(self.ors[level][b] ^ self.ands[level][b])
        return np.bitwise_count((self.ands[level][a] ^ self.ands[level][b]) & shared) <= most

    def join(self, most: int) -> Forest:
        """Links all fingerprints of one bucket that differ in at most so many bits."""
        top, forest = len(self.first) - 1, Forest(len(self.ands[0]))
        roots = np.arange(len(self.ands[top]))
        todo = [(top, roots, roots)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PAIRS:
                todo += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
                continue
            if level and level < top:
                open_ = ~self._joined(forest, level, a, b)
                a, b = a[open_], b[open_]
            if level == 0 or not len(a):
                continue
            first = self.first[level]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            size = na * nb
            pair = np.repeat(np.arange(len(a)), size)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            x, y = first[a][pair] + at // nb[pair], first[b][pair] + at % nb[pair]
            keep = (x < y) if level == 1 else (x <= y)
            x, y = x[keep], y[keep]
            keep = self.near(level - 1, x, y, most)
            x, y = x[keep], y[keep]
            if level == 1:
                forest.link(x, y)
            elif len(x):
                todo.append((level - 1, x, y))
        return forest

    def _joined(self, forest: Forest, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where all leaves below both nodes are in one component."""
        bounds = self.leaf[level]
        used = np.unique(np.concatenate([a, b]))
        low, high = (f.reduceat(forest.root, np.column_stack([bounds[used], bounds[used + 1]]).ravel().clip(max=len(forest.root) - 1))[::2] for f in (np.minimum, np.maximum))
        last = bounds[used + 1] == len(forest.root)  # reduceat over a range that ends with the array leaves its last leaf out
        low = np.where(last, np.minimum(low, forest.root[-1]), low)
        high = np.where(last, np.maximum(high, forest.root[-1]), high)
        ia, ib = np.searchsorted(used, a), np.searchsorted(used, b)
        return (low[ia] == high[ia]) & (low[ib] == high[ib]) & (low[ia] == low[ib])


def forest_of(prints: np.ndarray, keys: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """prints: uint64, sorted by keys and Gray rank. Links that join what lies within the distance: (print, print of its root)."""
    if len(prints) < 2:
        return prints[:0], prints[:0]
    root = Index(prints, _runs(keys)).join(most).root
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]
