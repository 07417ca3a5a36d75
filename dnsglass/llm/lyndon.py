"""Suffix arrays by Lyndon-prefix grouping, for many small texts side by side.

Phase 1 groups the suffixes of a text by their longest Lyndon prefix.  Groups are
taken in descending order; the previous-smaller pointers of a group's members
tell which lower suffixes extend their context by it, and those move into new
groups right behind their old ones, by the number of members that point to them.
Phase 2 emits the order inside the groups from left to right: the suffix that
was placed last places, along the pointers, those that it is the next smaller
suffix of.  No renaming, no recursion; the work on a text is linear.

The texts ("blocks") are independent, so each step handles one group of every
block at once with numpy; the number of steps is that of the largest block.
"""

from __future__ import annotations

import numpy as np

from .arrow import runs, spread


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of consecutive blocks, as positions in `symbols`.  The last
    symbol of every block is smaller than all others in it."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    start = np.cumsum(sizes) - sizes
    group, pointer = _groups(symbols, start, sizes)
    return _emit(group, pointer, start, sizes)


def _groups(symbols: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the first slot of its Lyndon group, and its previous-smaller pointer."""
    n, none = len(symbols), len(symbols)
    block = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(block * (int(symbols.max()) + 1) + symbols, kind="stable")
    edge = runs(block[order] * (int(symbols.max()) + 1) + symbols[order])
    group = np.empty(n + 1, np.int64)  # of a position: first slot of its group
    group[order] = np.repeat(edge[:-1], np.diff(edge))
    group[none] = -1
    end = np.zeros(n, np.int64)  # of a group's first slot
    end[edge[:-1]] = edge[1:]
    at = order.copy()  # the position in a slot
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    left, right = np.arange(-1, n), np.arange(1, n + 2)
    left[start] = none
    right[start + sizes - 1] = none
    left[none] = right[none] = none
    pointer = np.full(n + 1, none)
    moved = np.zeros(n, bool)
    floor, top = start.copy(), start + sizes
    while len(top):
        first = group[at[top - 1]]
        size = top - first
        members = np.sort(at[spread(first, size)])
        # neighbours of one group in the list of what is left share one pointer
        begin = np.flatnonzero(group[left[members]] != np.repeat(first, size))
        count = np.diff(np.r_[begin, len(members)])
        target = left[members[begin]]
        after = right[members[np.r_[begin[1:], len(members)] - 1]]
        pointer[members] = np.repeat(target, count)
        right[target], left[after] = after, target

        real = target != none
        target, count = target[real], count[real]
        if len(target):
            by = np.lexsort((count, group[target]))
            target, count = target[by], count[by]
            old = group[target]
            g = runs(old)
            total = np.diff(g)
            stop = end[old[g[:-1]]]
            new_slot = spread(stop - total, total)
            occupant, came_from = at[new_slot], slot[target]
            moved[target] = True
            stays = occupant[~moved[occupant]]
            holes = came_from[came_from < np.repeat(stop - total, total)]
            moved[target] = False
            at[holes], slot[stays] = stays, holes
            at[new_slot], slot[target] = target, new_slot
            h = runs_of_pairs(old, count)
            head = new_slot[h[:-1]]
            end[old[g[:-1]]] = stop - total
            end[head] = head + np.diff(h)
            group[target] = np.repeat(head, np.diff(h))
        more = first > floor
        top, floor = first[more], floor[more]
    return group, pointer


def runs_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, len(a)]


def _emit(group: np.ndarray, pointer: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays from the groups."""
    n = len(group) - 1
    none = n
    free = np.arange(n)  # of a group's first slot: its next free slot
    out = np.empty(n, np.int64)
    placed = np.zeros(n + 1, bool)
    placed[none] = True
    last = start + sizes - 1
    out[start] = last
    placed[last] = True
    free[group[last]] += 1
    step, size, first = 0, sizes, start
    while len(first):
        here = out[first + step]
        j = np.where(here > first, here - 1, none)
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = pointer[j]
            j = j[~placed[j]]
        step += 1
        more = size > step
        if not more.all():
            first, size = first[more], size[more]
    return out
