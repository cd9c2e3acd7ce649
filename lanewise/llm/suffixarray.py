"""Suffix arrays by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are taken in
descending order; each suffix of a group looks up its pointer to the nearest
earlier suffix of a lower group, and the suffixes so found leave their groups
for new ones just above, those found more often higher. When the lowest group
is done all groups are final, and one ascending sweep emits each group's
suffixes in order: a placed suffix fixes the places of the suffix before it and
of those along its pointers. No text is renamed and no recursion is used.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Positions of the suffixes of ``text`` in order, for symbols of at least 1."""
    symbols = [*text, 0]  # a last symbol below all others
    n = len(symbols)
    order = np.argsort(np.array(symbols), kind="stable").tolist()
    members: list[list[int]] = []
    group = [0] * n
    last = -1
    for i in order:
        if symbols[i] != last:
            last = symbols[i]
            members.append([])
        group[i] = len(members) - 1
        members[-1].append(i)
    above = list(range(1, len(members))) + [-1]
    below = list(range(-1, len(members) - 1))
    pointer = [-1] * n
    done = bytearray(n)

    current = len(members) - 1
    while current >= 0:
        held = [i for i in members[current] if group[i] == current]
        members[current] = held
        for i in held:
            done[i] = 1
        found: dict[int, int] = {}
        for i in held:
            j = i - 1
            while j >= 0 and done[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if found:
            if len(found) == 1:
                levels = [list(found)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, count in found.items():
                    by_count.setdefault(count, []).append(j)
                levels = [sorted(by_count[c]) for c in sorted(by_count, reverse=True)]
            for level in levels:
                fresh: dict[int, int] = {}
                for j in level:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    group[j] = new
                    members[new].append(j)
        current = below[current]

    start, free = 0, [0] * len(members)
    current = 0  # the last symbol's own group stays the lowest
    while current >= 0:
        free[current] = start
        start += len(members[current])
        current = above[current]
    result = [-1] * n
    placed = bytearray(n)
    result[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = pointer[j]
    return result[1:]


def classes(text: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and a class number for each: equal first ``length`` symbols."""
    order = np.array(suffix_array(text), dtype=np.int64)
    padded = np.concatenate([np.array(text, dtype=np.int64), np.zeros(length, np.int64)])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(length):
        at = padded[order + k]
        same &= at[1:] == at[:-1]
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(~same)])
