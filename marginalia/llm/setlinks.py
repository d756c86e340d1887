"""Exact links between sets within one cell of rows: bitmaps bound the difference of two sets from below, and what the
bound leaves is compared as a whole."""

from __future__ import annotations

import numpy as np

#: Bits of a set's bitmap.
BITMAP = 1024
#: Shingles that are looked up at once.
_AT_ONCE = 1 << 22


def bitmap(own: np.ndarray) -> np.ndarray:
    """A set of 64-bit hashes as a bitmap. Two bitmaps differ in no more places than the sets differ in members."""
    bits = np.zeros(BITMAP, bool)
    bits[(own % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def similar(common: np.ndarray, size_a: np.ndarray, size_b: int, share: tuple[int, int]) -> np.ndarray:
    """Whether intersections of this size make a Jaccard similarity of ``share`` or more."""
    return share[1] * common >= share[0] * (size_a + size_b - common)


def linked_sets(sets: list[np.ndarray], share: tuple[int, int], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that keep together exactly the sets which pairs of a Jaccard similarity of ``share`` (17, 20: 0.85)
    or more connect; with ``own``, only pairs of different chunks count. Empty sets have no links.

    Each set is held against those before it that are not yet together with it: first by size and bitmap, all at once,
    then with the nearest of each group, and only where that is too far with the group's others.
    """
    n = len(sets)
    root = np.arange(n)  # always the least member
    sizes = np.array([len(x) for x in sets], np.int64)
    if not n or not sizes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    maps = np.stack([bitmap(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    members = [codes[e - k : e] for e, k in zip(ends, sizes, strict=True)]
    mine = np.zeros(int(codes.max()) + 1, bool)
    numerator, denominator = share
    for i in range(n):
        if not sizes[i]:
            continue
        js = np.flatnonzero(denominator * np.minimum(sizes[:i], sizes[i]) >= numerator * np.maximum(sizes[:i], sizes[i]))
        js = js[(root[js] != root[i]) & (sizes[js] > 0)]
        if own is not None:
            js = js[own[js] != own[i]]
        if not len(js):
            continue
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1, dtype=np.int64)
        # common <= (both sizes - differing members) / 2
        ok = similar((sizes[js] + sizes[i] - apart) // 2, sizes[js], int(sizes[i]), share)
        js, apart = js[ok], apart[ok]
        js = js[np.argsort(apart, kind="stable")]
        mine[members[i]] = True
        for once in (True, False):
            js = js[root[js] != root[i]]
            some = js[np.sort(np.unique(root[js], return_index=True)[1])] if once else js
            for part in np.array_split(some, max(1, -(-int(sizes[some].sum()) // _AT_ONCE))):
                part = part[root[part] != root[i]]
                if not len(part):
                    continue
                starts = np.cumsum(sizes[part]) - sizes[part]
                common = np.add.reduceat(mine[np.concatenate([members[j] for j in part])].astype(np.int64), starts)
                for r in np.unique(root[part[similar(common, sizes[part], int(sizes[i]), share)]]):
                    low, high = min(r, root[i]), max(r, root[i])
                    root[root == high] = low
        mine[members[i]] = False
    nodes = np.flatnonzero(root != np.arange(n))
    return nodes, root[nodes]
