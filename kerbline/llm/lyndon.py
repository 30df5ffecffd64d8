"""Suffix arrays by linear grouping: groups of suffixes with one Lyndon prefix, in descending order."""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes of ``symbols``; the last symbol is 0 and occurs nowhere else.

    Suffixes start in groups by their first symbol, lower groups first. Groups are processed from
    the highest: each member finds its previous-smaller suffix, the nearest one to the left in a
    lower group. A suffix that ``m`` members point to continues with ``m`` copies of the group's
    prefix, so it leaves its own group for a new one directly above, the higher the larger ``m``.
    In the end each group holds the suffixes with one Lyndon prefix. Emitting then goes upward: the
    suffix before each placed one, and the chain of its pointers, take the next places of their groups.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, s in enumerate(order):
        if symbols[s] != symbols[order[start]]:
            start = at
        place[s], group[s] = at, start
        size[start] += 1
    smaller, leap = [-1] * n, [-1] * n
    last = n - 1
    while last >= 0:
        first = group[order[last]]
        members = sorted(order[first : last + 1])
        last = first - 1
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            # Members of higher groups are passed by what they found; the path is shortened.
            passed = []
            while p >= 0 and group[p] > first:
                passed.append(p)
                p = leap[p]
            for q in passed:
                leap[q] = p
            leap[s] = p
            if p >= 0 and group[p] == first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        layers: dict[int, list[int]] = {}
        for p, m in times.items():
            layers.setdefault(m, []).append(p)
        for m in sorted(layers, reverse=True):
            moved = layers[m]
            for p in moved:
                g = group[p]
                size[g] -= 1
                end = g + size[g]
                other, was = order[end], place[p]
                order[was], place[other] = other, was
                order[end], place[p] = p, end
            for p in moved:
                above = group[p] + size[group[p]]
                times[p] = above
            for p in moved:
                group[p] = times[p]
            for p in moved:
                size[group[p]] += 1
    return _emitted(group, smaller, n)


def _emitted(group: list[int], smaller: list[int], n: int) -> list[int]:
    following = list(range(n))
    out, done = [-1] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[following[g]] = s
            following[g] += 1
            done[s] = 1
            s = smaller[s]
    return out
