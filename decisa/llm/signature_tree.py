"""A signature tree over sets of 64-bit hashes, and the dual traversal that joins two trees.

A node holds the OR of its sets' token bitmaps, its range of set sizes and the most tokens that any of its sets loses
to shared bits. Two sets of nodes A and B have at most popcount(A & B) + loss tokens in common, so a pair of nodes is
dropped when even that overlap is too small for its smallest sizes, or when its sizes are too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
FANOUT = 8
PAIRS = 1 << 16


class SignatureTree:
    """Levels from the sets themselves (level 0) up to a single root; children of node i are FANOUT*i and on."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        least = np.fromiter((s[0] if len(s) else 0 for s in sets), U64, len(sets))
        self.order = np.lexsort((least, sizes))
        words = bits // 64
        maps = np.zeros((len(sets), bits), bool)
        for row, i in enumerate(self.order):
            maps[row, (sets[i] & U64(bits - 1)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(U64).reshape(len(sets), words)
        sizes = sizes[self.order]
        level = (packed, sizes, sizes, sizes - np.bitwise_count(packed).sum(axis=1, dtype=np.int64))
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)


def bitmap_bits(sizes: list[int]) -> int:
    """A width of about two bits a token of the median set, from 256 to 16,384."""
    want = 2 * int(np.median(sizes)) if sizes else 256
    return int(min(16384, max(256, 1 << (want - 1).bit_length())))


def _possible(a, i, b, j, num: int, den: int) -> np.ndarray:
    """Whether node pairs can hold a link: overlap * (num + den) >= num * (size + size) with the most overlap."""
    keep = np.flatnonzero((den * a[2][i] >= num * b[1][j]) & (den * b[2][j] >= num * a[1][i]))
    shared = np.bitwise_count(a[0][i[keep]] & b[0][j[keep]]).sum(axis=1, dtype=np.int64)
    most = shared + np.minimum(a[3][i[keep]], b[3][j[keep]])
    return keep[(num + den) * most >= num * (a[1][i[keep]] + b[1][j[keep]])]


def dual_traversal(x: SignatureTree, y: SignatureTree | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets that may link with num/den similarity, in bounded batches; y None: pairs within x."""
    same, y = y is None, y or x
    top = max(len(x.levels), len(y.levels)) - 1
    at = lambda tree, k: min(k, len(tree.levels) - 1)
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > PAIRS:
            half = len(i) // 2
            stack += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
            continue
        keep = _possible(x.levels[at(x, k)], i, y.levels[at(y, k)], j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k == 0:
            yield x.order[i], y.order[j]
            continue
        below = []
        for tree, nodes in ((x, i), (y, j)):
            if at(tree, k) == at(tree, k - 1):
                below.append(nodes[:, None])
            else:
                below.append(nodes[:, None] * FANOUT + np.arange(FANOUT))
        ni = np.repeat(below[0], below[1].shape[1], axis=1).ravel()
        nj = np.tile(below[1], (1, below[0].shape[1])).ravel()
        fits = (ni < len(x.levels[at(x, k - 1)][0])) & (nj < len(y.levels[at(y, k - 1)][0]))
        if same:
            fits &= ni < nj if k == 1 else ni <= nj
        stack.append((k - 1, ni[fits], nj[fits]))


class Forest:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def labels(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b|, for sorted distinct hashes."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def forest_edges(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int, first: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Verified links that connect all that link: (index, index) pairs, right ones counted after left ones; and labels.

    A pair whose sets are connected already is not verified again. first: a set to compare with all others before.
    """
    sets = left + (right or [])
    forest, edges = Forest(len(sets)), []

    def verify(pairs):
        for i, j in pairs:
            if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], num, den):
                forest.join(i, j)
                edges.append((i, j))

    if first is not None:
        verify((first, j) for j in range(len(sets)) if j != first)
    bits = bitmap_bits([len(s) for s in sets])
    x, y = SignatureTree(left, bits), SignatureTree(right, bits) if right is not None else None
    for i, j in dual_traversal(x, y, num, den):
        j = j + (len(left) if right is not None else 0)
        for a in range(0, len(i), 2048):
            labels = forest.labels()
            apart = labels[i[a : a + 2048]] != labels[j[a : a + 2048]]
            verify(zip(i[a : a + 2048][apart].tolist(), j[a : a + 2048][apart].tolist(), strict=True))
    return edges, forest.labels()
