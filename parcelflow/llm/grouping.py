"""Linear suffix array construction by grouping: Lyndon-prefix groups in descending order, then each group's order."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order. text ends with its only, smallest symbol.

    First phase: suffixes are grouped by their first symbol; groups are taken from the highest down. Each suffix of a group
    gets its pointer to the previous suffix of a lower group, and the suffixes pointed at move to new groups right after
    their own, higher the more often they are pointed at: the shared prefix of a group grows by whole groups, and no suffix
    is renamed. Second phase: from the smallest suffix on, the suffix before each one, and those along its pointers, take
    the next free place of their group.
    """
    n = len(text)
    codes = np.asarray(text)
    sa = np.argsort(codes, kind="stable").tolist()
    place = [0] * n
    group = [0] * n
    size: dict[int, int] = {}
    start = 0
    for k, i in enumerate(sa):
        if k and text[i] != text[sa[k - 1]]:
            size[start] = k - start
            start = k
        place[i] = k
        group[i] = start
    size[start] = n - start
    before = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[sa[end]]
        if start == end:
            i = sa[end]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            hits = {p: 1} if p >= 0 else {}
        else:
            hits = {}
            for i in sorted(sa[start : end + 1]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
        if hits:
            by_count: dict[int, list[int]] = {}
            for p, c in hits.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[c]:
                    g = group[p]
                    m = moved.get(g, 0) + 1
                    moved[g] = m
                    to = g + size[g] - m
                    at, other = place[p], sa[to]
                    sa[at], sa[to] = other, p
                    place[other], place[p] = at, to
                for g, m in moved.items():
                    if m < size[g]:
                        size[g] -= m
                        new = g + size[g]
                        size[new] = m
                        for k in range(new, new + m):
                            group[sa[k]] = new
        end = start - 1
    free = dict.fromkeys(size, 0)
    out = [-1] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + free[g]] = s
            free[g] += 1
            done[s] = True
            s = before[s]
    return out
