"""Suffix arrays by linear grouping of suffixes with equal Lyndon prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int] | np.ndarray) -> list[int]:
    """Starts of the suffixes of text in their order; a suffix precedes the longer ones that it begins.

    Phase 1 keeps suffixes in ordered groups, first by their first symbol, and takes the groups in
    descending order. A member's previous-smaller pointer is the nearest earlier suffix whose group is
    still to come. All suffixes to which equally many members of the group point (more of them first)
    leave their groups for new ones right above. In the end a group is all suffixes of one longest
    Lyndon prefix. Phase 2 passes once over the result and puts every suffix whose Lyndon prefix ends
    before the current one at the front of its group: no renaming and no recursion.
    """
    codes = np.unique(np.asarray(text), return_inverse=True)[1] + 1 if len(text) else np.zeros(0, np.int64)
    n = len(codes) + 1  # with an end symbol below all others
    first = np.append(codes, 0)
    order = np.argsort(first, kind="stable")
    bounds = np.flatnonzero(np.diff(first[order], prepend=-1)).tolist() + [n]
    of = first.tolist()  # the group of each suffix
    members = [order[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    count = [len(m) for m in members]
    lower, higher = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    skip = list(range(n))  # the nearest suffix at or before that is still to come
    smaller = [-1] * n

    group = len(members) - 1
    while group >= 0:
        own = [i for i in members[group] if of[i] == group]
        for i in own:
            skip[i] = i - 1
        points: dict[int, int] = {}
        for i in own:
            j = i - 1
            path = []
            while j >= 0 and (k := skip[j]) != j:
                path.append(j)
                j = k
            for k in path:
                skip[k] = j
            smaller[i] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        by: dict[int, list[int]] = {}
        for j, times in points.items():
            by.setdefault(times, []).append(j)
        for times in sorted(by, reverse=True):
            leave: dict[int, list[int]] = {}
            for j in by[times]:
                leave.setdefault(of[j], []).append(j)
            for old, moved in leave.items():
                if len(moved) == count[old]:
                    continue  # all of a group: its order among the groups stays
                new = len(members)
                members.append(moved)
                count.append(len(moved))
                count[old] -= len(moved)
                up = higher[old]
                lower.append(old)
                higher.append(up)
                higher[old] = new
                if up >= 0:
                    lower[up] = new
                for j in moved:
                    of[j] = new
        group = lower[group]

    front, at, group = [0] * len(members), 0, 0
    while group >= 0:
        front[group] = at
        at += count[group]
        group = higher[group]
    out, placed = [0] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = of[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix of the order shares with the one before it."""
    n = len(order)
    before, out, rank = [-1] * n, [0] * n, [0] * n
    for k in range(n):
        rank[order[k]] = k
        if k:
            before[order[k]] = order[k - 1]
    h = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[rank[i]] = h
        if h:
            h -= 1
    return out
