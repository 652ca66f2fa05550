"""Gray-order hierarchical index over bit fingerprints (after the HA-index of Tang et al., 2015).

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits. Runs of ``FAN`` become a
node that holds the bits they all share (mask and pattern); runs of nodes become a node of the next
level. A search descends pairs of nodes. Each level counts only differing bits that the levels above
have not yet compared, and a pair whose count passes the limit is dropped with all below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Pairs that one step of a descent expands at most; a bound on memory, not on results.
STEP = 1 << 20


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the binary reflected Gray order."""
    x = x.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class _Level:
    """Nodes over consecutive children: child ranges, shared mask and pattern, group."""

    def __init__(self, group: np.ndarray, every: np.ndarray, some: np.ndarray):
        new = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(new)
        place = np.arange(len(group)) - first[np.cumsum(new) - 1]
        self.start = np.flatnonzero(new | (place % FAN == 0))
        self.stop = np.r_[self.start[1:], len(group)]
        self.group = group[self.start]
        self.every = np.bitwise_and.reduceat(every, self.start, axis=0)
        self.some = np.bitwise_or.reduceat(some, self.start, axis=0)
        self.mask = ~(self.every ^ self.some)
        self.pattern = self.every & self.mask


def close_pairs(group: np.ndarray, prints: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i < j`` of one group whose fingerprints differ in ``limit`` bits or fewer.

    ``prints`` is ``(n, words)`` uint64, ordered by group and within it by Gray rank.
    """
    levels = []
    at, every, some = group, prints, prints
    while len(at):
        level = _Level(at, every, some)
        levels.append(level)
        if len(level.group) == len(np.unique(level.group)):
            break
        at, every, some = level.group, level.every, level.some
    if not levels:
        return
    roots = np.arange(len(levels[-1].start))
    work = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int16))]
    while work:
        depth, a, b, gone = work.pop()
        level = levels[depth]
        na, nb = level.stop[a] - level.start[a], level.stop[b] - level.start[b]
        many = na * nb
        if len(a) > 1 and many.sum() > STEP:
            half = len(a) // 2
            work += [(depth, a[half:], b[half:], gone[half:]), (depth, a[:half], b[:half], gone[:half])]
            continue
        of = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        i, j = level.start[a][of] + k // nb[of], level.start[b][of] + k % nb[of]
        ok = (i < j) | ((i == j) & (depth > 0)) | (a[of] != b[of])
        i, j, of = i[ok], j[ok], of[ok]
        above = level.mask[a[of]] & level.mask[b[of]]
        if depth:
            below = levels[depth - 1]
            fresh = below.mask[i] & below.mask[j] & ~above
            diff = (below.pattern[i] ^ below.pattern[j]) & fresh
        else:
            diff = (prints[i] ^ prints[j]) & ~above
        total = gone[of] + np.bitwise_count(diff).sum(axis=1, dtype=np.int16)
        ok = total <= limit
        if depth:
            work.append((depth - 1, i[ok], j[ok], total[ok]))
        elif ok.any():
            yield i[ok], j[ok]


def link(group: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """For each row the index of its component's first row; links join rows of one group within ``limit`` bits.

    The pairs are merged as they are found, so a large group of near copies never holds all its pairs.
    """
    label = np.arange(len(group))
    for u, v in close_pairs(group, prints, limit):
        while True:
            lu, lv = label[u], label[v]
            apart = lu != lv
            if not apart.any():
                break
            u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label
