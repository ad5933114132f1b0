"""Plain statements of what the operators compute, for comparison on small data."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, linked):
    """Component of each of n items, from a function of pairs."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(n)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by source (None last): shared by weight, what is above a limit shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_ = {}, list(names)
    left = budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def covered(rows, length=50):
    """Removed byte positions of (doc_id, text) rows."""
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s not in first or first[s] > key(d):
                first[s] = key(d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cov = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key(d):
                cov[i:i + length] = True
        out.append(cov)
    return out


def jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 1.0


def unsigned(x):
    return x + (1 << 64) if x < 0 else x
