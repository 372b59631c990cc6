"""Suffix arrays by the grouping construction.

First phase: suffixes begin in groups by their first byte. Groups are taken in descending
order; from each of its suffixes a pointer goes to the previous position of a smaller group
(over positions that were taken before, whose pointers are known). A position that is pointed
at has the group's prefix behind its own, once for each pointer, so it moves behind the rest of
its group, the more pointers the further. When all groups were taken, suffixes are grouped by
their Lyndon prefixes and groups are in suffix order. Second phase: in ascending order, each
suffix emits those before it that it is the next smaller one of, along the same pointers, to the
next free place of their group. Every step moves or takes a suffix once; no ranks are renamed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``text`` in order, and the first place of each suffix's Lyndon group.

    text: numbers from 0; 0 ends a row and must stand first, too. Zeros are smaller than all else
    and ordered by position, so equal suffixes of several rows keep the order of their rows, and a
    suffix that is a prefix of another comes first. No numbers: two empty arrays.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(text)
    start = np.cumsum(count) - count
    group = start[text].tolist()
    by = np.argsort(text, kind="stable")
    members: list = [()] * n
    size, below = [0] * n, [0] * (n + 1)
    for c in np.flatnonzero(count).tolist():
        g = int(start[c])
        size[g], below[g + int(count[c])] = int(count[c]), g
        members[g] = by[g : g + size[g]].tolist()
    n_rows, pointer, end = int(count[0]), [0] * n, n
    while end > n_rows:
        g = end = below[end]
        before, times, old, many = [], [], -1, 1
        for i in members[g]:
            if group[i] == g:
                p = i - 1
                while group[p] >= g:
                    p = pointer[p]
                pointer[i] = p
                if p != old:  # pointers of a group ascend, so equal ones are neighbours
                    old = p
                    before.append(p)
                    times.append(1)
                else:
                    times[-1] += 1
                    many = max(many, times[-1])
        for k in range(many, 0, -1):
            moves: dict[int, list[int]] = {}
            for p in before if many == 1 else [p for p, t in zip(before, times, strict=True) if t == k]:
                h = group[p]
                if h in moves:
                    moves[h].append(p)
                elif h >= n_rows:  # the ends of rows stay where they are
                    moves[h] = [p]
            for h, who in moves.items():
                rest = size[h] - len(who)
                if rest:
                    new = h + rest
                    below[h + size[h]], below[new] = new, h
                    size[h], size[new], members[new] = rest, len(who), who
                    for p in who:
                        group[p] = new
    free, out, placed = list(range(n)), [0] * n, bytearray(n)
    for k, i in enumerate(by[:n_rows].tolist()):
        out[k], placed[i] = i, 1
    for i in out:  # places ahead are filled while it runs
        p = i - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = pointer[p]
    return np.array(out, np.int64), np.array(group, np.int64)
