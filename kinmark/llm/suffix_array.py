"""Suffix sorting by Lyndon-prefix groups, linear but for one sort of each group's members by place.

Suffixes start in one group for each first symbol. Groups are visited in descending order; each member points to
the nearest earlier suffix of a smaller group, and the suffixes pointed at move into new groups right above their
old ones (a prefix ``u`` becomes ``u v``, or ``u v v`` ..., where ``v`` is the visited group's prefix). At the end
every group holds the suffixes with one longest Lyndon prefix. A second pass walks the order upwards: when a
suffix is placed, those whose Lyndon prefix ends where it begins are placed at the front of their groups. Nothing
is renamed and no smaller problem is solved recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes of an integer sequence in ascending order; a shorter suffix that is a prefix of
    another comes first."""
    n = len(symbols) + 1  # with an end mark below all symbols
    text = np.concatenate([np.asarray(symbols, dtype=np.int64), [np.int64(np.iinfo(np.int64).min)]])
    by_first = np.argsort(text, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(text[by_first]) != 0]))
    sa: list[int] = by_first.tolist()
    at = np.empty(n, np.int64)
    at[by_first] = np.arange(n)
    place: list[int] = at.tolist()
    group_of = np.empty(n, np.int64)
    group_of[by_first] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    group: list[int] = group_of.tolist()
    sizes = np.zeros(n, np.int64)
    sizes[firsts] = np.diff(np.append(firsts, n))
    size: list[int] = sizes.tolist()
    prior = [-1] * n
    end = n - 1
    while end > 0:
        start = group[sa[end]]
        members = sa[start : end + 1]
        end = start - 1
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prior[j]
            prior[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if not times:
            continue
        counts = set(times.values())
        for k in sorted(counts, reverse=True):
            moved = [j for j, t in times.items() if t == k] if len(counts) > 1 else list(times)
            for j in moved:
                g = group[j]
                size[g] -= 1
                e, p = g + size[g], place[j]
                other = sa[e]
                sa[e], sa[p] = j, other
                place[j], place[other] = e, p
            fresh = [group[j] + size[group[j]] for j in moved]
            for j, g in zip(moved, fresh, strict=True):
                group[j] = g
                size[g] += 1
    # the second pass: free[g] is the next free place of the group that starts at g
    free = list(range(n))
    placed = [False] * n
    out = [n - 1] * n
    placed[n - 1] = True
    for x in range(n):
        j = out[x] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prior[j]
    return out[1:]
