"""Suffix arrays by linear grouping, without recursive renaming, and longest common prefixes.

First all suffixes are grouped by their longest Lyndon prefixes: groups are taken from the highest down; each member
points to the nearest earlier suffix of a lower group, and the suffixes so pointed at leave their groups upwards, those
with more pointers further up. Then the groups' inner orders come out in one pass from the lowest suffix on: the
suffixes that end their Lyndon prefix where a suffix begins take the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> tuple[list[int], list[int]]:
    """The order of all suffixes of a sequence of integers, and the rank of each.

    An end counts as smaller than every symbol.
    """
    n = len(symbols) + 1
    if n == 1:
        return [], []
    order = sorted(range(n - 1), key=symbols.__getitem__)
    place_of = [n - 1, *order]  # suffixes, group by group
    at = [0] * n  # where a suffix stands in place_of
    group = [0] * n  # the start of its group
    size = [0] * n  # of the group that starts here
    start, was = 0, None
    for k, i in enumerate(place_of):
        now = None if k == 0 else symbols[i]
        if k and (k == 1 or now != was):
            start = k
        was = now
        at[i], group[i] = k, start
        size[start] += 1
    size[0] = 1

    previous = [-1] * n
    count = [0] * n
    top = n - 1
    while top > 0:
        low = group[place_of[top]]
        members = place_of[low : top + 1]
        if len(members) > 1:
            members.sort()
        met = []
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                if not count[p]:
                    met.append(p)
                count[p] += 1
        if met:
            by_count: dict[int, list[int]] = {}
            for p in met:
                by_count.setdefault(count[p], []).append(p)
                count[p] = 0
            for c in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[c]:
                    g = group[p]
                    k = moved.get(g, 0)
                    last = g + size[g] - 1 - k
                    other, here = place_of[last], at[p]
                    place_of[last], place_of[here] = p, other
                    at[p], at[other] = last, here
                    moved[g] = k + 1
                for g, k in moved.items():
                    if k < size[g]:
                        size[g] -= k
                        fresh = g + size[g]
                        size[fresh] = k
                        for j in range(fresh, fresh + k):
                            group[place_of[j]] = fresh
        top = low - 1

    result = [-1] * n
    placed = [False] * n
    free = list(range(n))
    result[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = previous[j]
    del result[0]
    rank = [0] * (n - 1)
    for k, i in enumerate(result):
        rank[i] = k
    return result, rank


def common_prefixes(symbols: Sequence[int], order: Sequence[int], rank: Sequence[int]) -> list[int]:
    """For each place of the order, the symbols that its suffix shares with the one before; 0 for the first."""
    n, h = len(symbols), 0
    out = [0] * n
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
                h += 1
            out[k] = h
            h -= h > 0
        else:
            h = 0
    return out
