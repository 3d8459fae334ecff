"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then each group's order.

First suffixes are grouped by their first symbol. From the greatest group down,
each suffix of the group finds its previous smaller suffix, the last one before
it whose group is lower; such a predecessor is followed by the group's prefix
once for each suffix that points to it, so within its own group it moves above
those that fewer point to. When all groups are done, they are the classes of
equal Lyndon prefixes, in order. A group is then emitted in the order of what
follows its prefix: walking the array from its least entry, each entry places
the suffixes before it that are not placed yet, along the same pointers. No
string is renamed, and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the end is less than any symbol."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    group = np.empty(n, dtype=np.int64)  # of each suffix: where its group begins
    group[order] = np.repeat(starts, sizes)
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    sa, group, where = order.tolist(), group.tolist(), where.tolist()
    size = dict(zip(starts.tolist(), sizes.tolist(), strict=True))
    prev = [-1] * n

    end = n
    while end > 0:
        begin = group[sa[end - 1]]
        points: dict[int, int] = {}
        for s in sorted(sa[begin:end]) if end - begin > 1 else (sa[begin],):
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        if len(points) == 1:
            by_count = [list(points)]
        else:
            classes: dict[int, list[int]] = {}
            for p, m in points.items():
                classes.setdefault(m, []).append(p)
            by_count = [classes[m] for m in sorted(classes, reverse=True)]
        for moved in by_count:  # those that most point to go highest
            taken: dict[int, int] = {}
            for p in moved:
                g = group[p]
                k = taken.get(g, 0) + 1
                taken[g] = k
                to, at = g + size[g] - k, where[p]
                if to != at:
                    q = sa[to]
                    sa[to], sa[at] = p, q
                    where[p], where[q] = to, at
            for g, k in taken.items():
                if k < size[g]:
                    new = g + size[g] - k
                    size[g] -= k
                    size[new] = k
                    for i in range(new, new + k):
                        group[sa[i]] = new
        end = begin

    out, free, placed = [0] * n, {}, bytearray(n)

    def place(s: int) -> None:
        x = s - 1
        while x >= 0 and not placed[x]:
            g = group[x]
            at = free.get(g, g)
            out[at] = x
            free[g] = at + 1
            placed[x] = 1
            x = prev[x]

    place(n)
    for i in range(n):
        place(out[i])
    return np.array(out, dtype=np.int64)
