"""Suffix arrays by linear grouping construction, of many strings at a time.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups start
out as the suffixes of one first symbol and are processed in descending order.
Each member i has a previous-smaller pointer: the nearest position to its left
whose group is lower. Positions to which l members point are l times followed by
the group's prefix; they leave their own group for a new one right above it,
larger l first. A group is an interval of the suffix array and is named by where
it starts, so a split is a move to the interval's end, and no symbol is renamed.

Phase 2 emits each group's order: going up the suffix array, each entry's left
neighbour and the chain of its previous-smaller pointers, as far as not yet
placed, take the next places of their groups.

Each position is processed once in a phase and each pointer followed once. The
strings go in step: in every round each string processes its next group, with
one array operation for all of them, so rounds are as many as the groups of the
longest string.
"""

from __future__ import annotations

import numpy as np


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + size), one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions in suffix order, string by string.

    ``symbols`` holds the strings one after the other; each ends with a symbol that
    is smaller than all others in it and occurs nowhere else in it.
    """
    n = len(symbols)
    starts = np.asarray(starts, np.int64)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    string = np.repeat(np.arange(len(starts)), ends - starts)
    begin = starts[string]

    sa = np.lexsort((symbols, string))
    at = np.empty(n, np.int64)
    at[sa] = np.arange(n)
    new = np.r_[True, (symbols[sa][1:] != symbols[sa][:-1]) | (string[sa][1:] != string[sa][:-1])]
    first = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.r_[first, n])
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(first, size[first])

    prev = np.full(n, -1, np.int64)
    mine = np.zeros(n, np.int64)        # a member's number in its round
    moving = np.zeros(n, bool)
    top, live = ends.copy(), np.arange(len(starts))
    while len(live):
        g = group[sa[top[live] - 1]]
        sizes = top[live] - g
        i = sa[ragged(g, sizes)]
        own = np.repeat(g, sizes)
        j = np.where(i > begin[i], i - 1, -1)
        todo = np.flatnonzero(j >= 0)
        while len(todo):                # over higher groups, by their pointers
            todo = todo[group[j[todo]] > own[todo]]
            j[todo] = prev[j[todo]]
            todo = todo[j[todo] >= 0]
        mine[i] = np.arange(len(i))
        todo = np.flatnonzero(j >= 0)
        todo = todo[group[j[todo]] == own[todo]]
        while len(todo):                # over members of the group itself
            j[todo] = j[mine[j[todo]]]
            todo = todo[j[todo] >= 0]
            todo = todo[group[j[todo]] == own[todo]]
        prev[i] = j
        p, times = np.unique(j[j >= 0], return_counts=True)
        for l in np.unique(times)[::-1]:
            m = p[times == l]
            m = m[np.argsort(group[m], kind="stable")]
            old, count = np.unique(group[m], return_counts=True)
            end = old + size[old]
            to = end - count
            moving[m] = True
            slots = ragged(to, count)
            held = sa[slots]
            out = ~moving[held]
            stay = at[m] >= np.repeat(to, count)
            moving[m] = False
            came, away = m[~stay], held[out]
            free, there = at[came].copy(), slots[out]
            sa[there], at[came] = came, there
            sa[free], at[away] = away, free
            size[old] -= count
            size[to] = count
            group[m] = np.repeat(to, count)
        top[live] = g
        live = live[g > starts[live]]

    out = np.full(n, -1, np.int64)
    out[starts] = ends - 1
    placed = np.zeros(n, bool)
    placed[ends - 1] = True
    front = np.arange(n)
    live, t = np.arange(len(starts)), 0
    length = ends - starts
    while len(live):
        s = out[starts[live] + t]
        j = np.where(s > begin[s], s - 1, -1)
        j = j[j >= 0]
        while len(j):                   # one chain for each string
            j = j[~placed[j]]
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = prev[j]
            j = j[j >= 0]
        t += 1
        live = live[length[live] > t]
    return out
