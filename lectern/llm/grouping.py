"""Suffix array by grouping: two passes over a sequence of numbers, no recursion and no renaming.

First pass: suffixes are kept in groups that stand in order, each a range of one array, at first by their first
symbol. Groups are taken from the highest to the lowest. Every suffix of the group in hand points to the nearest
position before it whose group is lower (its previous smaller one). A suffix that is pointed to has a Lyndon prefix
that goes on with the group's prefix, so it leaves its own group for a new one just above, the higher the more often
it is pointed to. In the end each group holds the suffixes with one Lyndon prefix.

Second pass: from the lowest suffix on, the suffix before each one found takes the next free place of its group, then
its previous smaller one does, and so on along the pointers. That puts every group in order.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers, as if a smaller symbol than all followed the last one."""
    size = len(symbols)
    if not size:
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    ordered = np.argsort(text, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(text[ordered]) > 0)))
    of = np.empty(size + 1, np.int64)
    of[ordered] = np.repeat(starts, np.diff(np.append(starts, size + 1)))
    places = np.empty(size + 1, np.int64)
    places[ordered] = np.arange(size + 1)
    counts = np.zeros(size + 1, np.int64)
    counts[starts] = np.diff(np.append(starts, size + 1))
    group, smaller = _grouped(ordered.tolist(), of.tolist(), places.tolist(), counts.tolist())
    return np.array(_emitted(group, smaller), np.int64)[1:]


def _grouped(order: list, group: list, place: list, count: list) -> tuple[list, list]:
    """Groups by Lyndon prefix (named by where their range starts) and the previous smaller pointers."""
    smaller = [-1] * len(order)
    end = len(order)
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            at = order[start]
            to = at - 1
            while to >= 0 and group[to] >= start:
                to = smaller[to]
            smaller[at] = to
            if to >= 0:
                # The one suffix pointed to goes to the end of its range and is a group of its own there.
                own = group[to]
                last = own + count[own] - 1
                if last != own:
                    there, mine = order[last], place[to]
                    order[mine], order[last] = there, to
                    place[there], place[to] = mine, last
                    count[own] -= 1
                    count[last] = 1
                    group[to] = last
            end = start
            continue
        pointed: dict[int, int] = {}
        for at in sorted(order[start:end]):
            to = at - 1
            while to >= 0 and group[to] >= start:
                to = smaller[to]
            smaller[at] = to
            if to >= 0:
                pointed[to] = pointed.get(to, 0) + 1
        by_times: dict[int, list[int]] = {}
        for to, times in pointed.items():
            by_times.setdefault(times, []).append(to)
        for times in sorted(by_times, reverse=True):
            moved = by_times[times]
            owners = []
            for to in moved:
                own = group[to]
                owners.append(own)
                count[own] -= 1
                last = own + count[own]
                there, mine = order[last], place[to]
                order[mine], order[last] = there, to
                place[there], place[to] = mine, last
            new = {own: own + count[own] for own in owners}
            for to, own in zip(moved, owners, strict=True):
                count[new[own]] += 1
                group[to] = new[own]
        end = start
    return group, smaller


def _emitted(group: list, smaller: list) -> list:
    free = list(range(len(group)))
    out, done = [-1] * len(group), [False] * len(group)
    out[0] = len(group) - 1
    for i in range(len(group)):
        at = out[i] - 1
        while at >= 0 and not done[at]:
            own = group[at]
            out[free[own]] = at
            free[own] += 1
            done[at] = True
            at = smaller[at]
    return out
