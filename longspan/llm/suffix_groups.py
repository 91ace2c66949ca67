"""Suffix arrays of many small texts at once, by grouping suffixes under their Lyndon prefixes.

Two phases, both linear in the text. The first starts from groups of suffixes with one first
symbol and takes the groups in descending order. Each member looks up its previous smaller suffix,
the nearest to its left in a lower group, by following pointers that are already known; those
suffixes now have the group's prefix behind their own, so they leave their group for a new one just
above it, the more often they were pointed at the higher. In the end a group holds the suffixes
that share a Lyndon prefix, and groups are in the order of their suffixes. The second phase goes
up the array: each suffix met puts the suffix to its left, and those that this one points to, into
the next free place of their groups. Nothing is renamed or sorted again.

The texts of a batch go through the steps side by side, one group (then one place) of each text at
a time, so that a step is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + counts, counts)


def _lift(moved: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray) -> None:
    """Move suffixes into new groups just above their own, those of one group together."""
    moved = moved[np.argsort(group[moved], kind="stable")]
    old, first, counts = np.unique(group[moved], return_index=True, return_counts=True)
    new = old + size[old] - counts
    own_new = np.repeat(new, counts)
    targets = _spread(new, counts)
    leaving = np.zeros(len(targets), bool)
    inside = place[moved] >= own_new
    leaving[np.searchsorted(targets, place[moved[inside]])] = True
    holes, displaced = place[moved[~inside]], order[targets[~leaving]]
    order[holes], place[displaced] = displaced, holes
    order[targets], place[moved] = moved, targets
    size[old] -= counts
    size[new] = counts
    group[moved] = own_new


def suffix_arrays(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes in ascending order, text by text.

    Text t is symbols[begins[t]:ends[t]], texts lie back to back, and each ends with a symbol that
    is smaller than all others in it.
    """
    n = len(symbols)
    text = np.repeat(np.arange(len(begins)), ends - begins)
    order = np.lexsort((symbols, text))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    starts = np.flatnonzero(head)
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, size[starts])
    first_of = begins[text]
    smaller = np.arange(n) - 1
    smaller[begins] = -1

    top = ends.copy()
    live = np.flatnonzero(top > begins)
    while len(live):
        low = group[order[top[live] - 1]]
        counts = top[live] - low
        members, mine = order[_spread(low, counts)], np.repeat(low, counts)
        smaller[members] = np.where(members > first_of[members], members - 1, -1)
        chase, bar = members, mine
        while True:
            at = smaller[chase]
            go = (at >= 0) & (group[at] >= bar)
            if not go.any():
                break
            chase, bar = chase[go], bar[go]
            smaller[chase] = smaller[at[go]]
        found, times = np.unique(smaller[members], return_counts=True)
        if len(found) and found[0] < 0:
            found, times = found[1:], times[1:]
        for k in np.unique(times)[::-1]:
            _lift(found[times == k], order, place, group, size)
        top[live] = low
        live = live[low > begins[live]]

    free = np.arange(n)
    done = np.zeros(n, bool)
    result = np.full(n, -1, np.int64)
    result[begins], done[ends - 1] = ends - 1, True
    free[begins] += 1
    walk, left = begins.copy(), ends - 2
    stop, start = ends, begins
    while len(walk):
        put = left >= start
        put[put] = ~done[left[put]]
        at = left[put]
        spot = group[at]
        result[free[spot]] = at
        free[spot] += 1
        done[at] = True
        left[put] = smaller[at]
        # Others go on to the next place.
        walk[~put] += 1
        stay = walk < stop
        if not stay.all():
            walk, left, stop, start, put = walk[stay], left[stay], stop[stay], start[stay], put[stay]
        left[~put] = result[walk[~put]] - 1
    return result
