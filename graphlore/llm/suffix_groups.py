"""Suffix sorting by linear grouping.

Suffixes start in groups of equal first symbols. Groups are taken from the
greatest down; each suffix of a group points to the nearest one before it
that lies in a smaller group, and those pointed at, as often as they are
pointed at, move to new groups just above their own: a group always holds
the suffixes that begin with one Lyndon word. A second sweep emits the order
inside each group by following the same pointers, so nothing is renamed and
sorted again.
"""

from __future__ import annotations

from itertools import groupby


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; a proper prefix comes first."""
    n = len(text)
    previous, group = [-1] * n, [0] * n
    # groups as a list linked downwards: members, and the next smaller group; 0 is below all
    members: list[list[int]] = [[]]
    below = [-1]
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        members.append(by_symbol[c])
        below.append(len(members) - 2)
        for i in by_symbol[c]:
            group[i] = len(members) - 1
    above = [k + 1 for k in range(len(members))]
    done = [False] * n
    at = len(members) - 1
    while at > 0:
        own = sorted(i for i in members[at] if group[i] == at)
        members[at] = own
        pointed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and (done[p] or group[p] == at):
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        for s in own:
            done[s] = True
        # the most pointed at first: each new group goes right above its old one, so it ends up the highest
        moves = sorted(((times, group[p], p) for p, times in pointed.items()), key=lambda x: (-x[0], x[1]))
        for (_, old), those in groupby(moves, key=lambda x: x[:2]):
            new = len(members)
            moved = [p for _, _, p in those]
            members.append(moved)
            for p in moved:
                group[p] = new
            top = above[old]
            below.append(old)
            above.append(top)
            above[old] = new
            if top < len(below) and top != new:
                below[top] = new
        at = below[at]
    # first free place of each group, in ascending order
    place, k, free = [0] * len(members), above[0], 0
    for _ in range(len(members) - 1):
        place[k] = free
        free += sum(1 for i in members[k] if group[i] == k)
        k = above[k]
    order, put = [-1] * n, [False] * n

    def emit(s: int) -> None:
        while s >= 0 and not put[s]:
            put[s] = True
            order[place[group[s]]] = s
            place[group[s]] += 1
            s = previous[s]

    emit(n - 1)  # what follows the end is smaller than any suffix
    for k in range(n):
        emit(order[k] - 1)
    return order
