"""Removal of repeated passages with suffix arrays (linear grouping construction).

Every byte covered by a ``LENGTH``-byte string that also starts in a document of
a smaller doc_id goes; strings are those of the input, and matches never cross
documents. No suffix array of the whole corpus is built; strings that may repeat
are brought together first, exactly:

1. Each window of LENGTH bytes has an anchor, the least hash of its ``GRAM``-byte
   substrings. Equal windows have equal anchors. Blocks of documents ask in how
   many documents each of their anchors occurs (packed, 40 bits an anchor, dealt
   out by hash); windows whose anchor is nowhere else are done.
2. Runs of windows with one anchor form segments. A block sends each distinct
   segment once, with its smallest doc_id, to the shard of its anchor. Anchors of
   more than ``HOT`` documents are spread: their windows go one by one, by their
   own hash, so no passage, however common, meets in one place as often as it occurs.
3. A shard drops windows whose hash occurs once, collapses equal segments, and
   concatenates what is left of each anchor. Suffix arrays (suffixes.py) put
   equal windows side by side; neighbours are compared byte by byte, and each run
   of equal windows gets its smallest doc_id, which goes back to the blocks.
4. A block joins its answers and cuts the covered bytes of each of its documents. Where
   its segments lie came with its requests: the windows are not hashed for it again.

Hash collisions can only bring more to compare; what is removed is decided by
bytes. The documents are read from the input three times (a table whose scans
give the same rows each time is needed) and move twice, compressed.

Defined results: null and empty texts, and texts shorter than LENGTH, lose
nothing; a null doc_id is larger than all others; rows that repeat a doc_id lose
nothing to each other; an empty table gives an empty table; other columns pass.
What is kept is bytes: a cut may fall into a character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from ..session import ensure_checkpoint_dir
from .blocks import (
    blocks, from_bytes, frugal, frugal_group, frugal_pair, pack, pack_numbers, to_bytes, unpack, unpack_numbers,
)
from .suffixes import ragged, suffix_arrays
from .text import need, spare

LENGTH = 50
GRAM = 24                   # bytes of an anchor
HOT = 2_000                 # documents from which an anchor's windows are dealt out one by one
BLOCK_BYTES = 8_000_000     # text of a block
SHARD_BYTES = 4_000_000     # text for each shard
CHUNK_BYTES = 125_000       # bytes hashed at a time
STRING = 4_096              # bytes of an anchor's variants from which they are dealt out by window
MAX_SHARDS = 50_000
LAST = np.iinfo(np.int64).max       # stands for a null doc_id
LOW = np.uint64((1 << 40) - 1)
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                   0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93,
                                   0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= ODD[5]
    x ^= x >> np.uint64(29)
    x *= ODD[6]
    x ^= x >> np.uint64(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    n = len(data) - 7
    return np.ndarray((max(n, 0),), "<u8", data, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def hashes(data: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes (8 or more) from each place on, or from the places ``at``."""
    v, n = eights(data), len(data) - length + 1 if at is None else len(at)
    if n <= 0:
        return np.zeros(0, np.uint64)
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] != length - 8:
        offsets.append(length - 8)
    if at is None:
        v = np.ascontiguousarray(v)     # aligned
    h, step = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k, o in enumerate(offsets):
        if k:
            h ^= np.right_shift(h, np.uint64(31), out=step)
        h += np.multiply(v[o:o + n] if at is None else v[at + o], ODD[k % 5], out=step)
        h *= ODD[(k + 1) % 5]
    return mixed(h)


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, by doubling."""
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:len(h) - span], h[span:])
        span *= 2
    if span < w:
        h = np.minimum(h[:len(h) - (w - span)], h[w - span:])
    return h


class Runs:
    """Runs of windows of one document and one anchor, ``GRAM`` windows long at most."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        parts: list[tuple] = []
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        a = 0
        while a < len(texts):           # documents of about CHUNK_BYTES; a longer one in pieces
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + CHUNK_BYTES, side="right")))
            for x in range(int(self.starts[a]), int(self.ends[b - 1]), 4 * CHUNK_BYTES):
                parts.append(self._of(x, min(int(self.ends[b - 1]), x + 4 * CHUNK_BYTES + length - 1), a, b, gram))
            a = b
        self.doc, self.start, self.n, self.key = (
            np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _of(self, x: int, y: int, a: int, b: int, gram: int) -> tuple:
        least = window_least(hashes(self.data[x:y], gram), self.length - gram + 1)
        # the windows of each document, not of two
        first = np.maximum(self.starts[a:b], x)
        own = np.maximum(np.minimum(self.ends[a:b] - self.length + 1, x + len(least)) - first, 0)
        at = ragged(first, own)
        doc = np.repeat(np.arange(a, b), own)
        least = least[at - x]
        if not len(at):
            return at, at, at, least
        cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
        n = np.diff(np.r_[cut, len(at)])
        pieces = -(-n // gram)          # a periodic text may keep its anchor for long
        first = np.repeat(cut, pieces)
        place = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first + place * gram
        return doc[begin], at[begin], np.minimum(gram, np.repeat(cut + n, pieces) - begin), least[begin]


def dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and from where to where each stands."""
    values, at = np.unique(x, return_index=True)
    return values, at, np.append(at, len(x))[1:]


def in_shard_order(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = dealt(key, shards)
    return np.argsort((shard.astype(np.uint64) << np.uint64(40)) | (key & LOW), kind="stable"), shard


def anchors(runs: Runs, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct anchors, in how many of its documents they are, and their shards, in shard order."""
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.cumsum(np.r_[False, np.diff(ids[by_id]) != 0][:len(ids)])     # rows of one doc_id are one
    doc = place[runs.doc]
    if (doc[1:] < doc[:-1]).any():
        pair = np.lexsort((doc, runs.key))
    else:       # runs come by document
        pair = np.argsort(runs.key, kind="stable")
    key, doc = runs.key[pair], doc[pair]
    other = np.r_[True, key[1:] != key[:-1]][:len(key)]
    new = other | np.r_[True, doc[1:] != doc[:-1]][:len(key)]
    first = np.flatnonzero(other)
    key, count = key[first], np.add.reduceat(new, first, dtype=np.int64) if len(first) else first
    order, shard = in_shard_order(key, shards)
    return key[order], np.minimum(count[order], 255).astype(np.uint8), shard[order]


def segments(runs: Runs, ids: np.ndarray, code: np.ndarray) -> tuple:
    """A block's distinct segments: bytes, keys and smallest doc_ids; and its occurrences
    (segment, document, place, windows). ``code`` is of each run: 1 shared, 2 common."""
    found: dict[bytes, int] = {}
    keys: list[int] = []
    data, length = runs.data.tobytes(), runs.length
    one = np.flatnonzero(code == 1)
    many = np.flatnonzero(code == 2)
    start = np.concatenate([runs.start[one], ragged(runs.start[many], runs.n[many])])
    n = np.concatenate([runs.n[one], np.ones(int(runs.n[many].sum()), np.int64)])
    doc = np.concatenate([runs.doc[one], np.repeat(runs.doc[many], runs.n[many])])
    of = np.empty(len(start), np.int64)
    ends = (start + n + length - 1).tolist()
    run_key = runs.key[one].tolist()
    for i, (a, b) in enumerate(zip(start.tolist(), ends, strict=True)):
        s = data[a:b]
        k = found.get(s)
        if k is None:
            k = found[s] = len(found)
            keys.append(run_key[i] if i < len(one) else xxhash.xxh3_64_intdigest(s))
        of[i] = k
    least = np.full(len(found), LAST)
    np.minimum.at(least, of, ids[doc])
    return list(found), np.array(keys, np.uint64), least, (of, doc, start, n)


# ---- the shard

def equal_runs(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each window is equal to the one before it, byte by byte."""
    same = np.zeros(len(starts), bool)
    for a in range(1, len(starts), 100_000):
        x, y = starts[a - 1:a + 99_999], starts[a:a + 100_000]
        ok = np.ones(len(y), bool)
        for o in range(length):
            ok &= data[x[:len(y)] + o] == data[y + o]
        same[a:a + 100_000] = ok
    return same


def collapsed(blob: np.ndarray, at: np.ndarray, parts: np.ndarray, key: np.ndarray, length: int) -> tuple:
    """Distinct runs of windows of each key: (key, bytes) in order, the run's kind, first window and windows."""
    cut = np.flatnonzero(parts)
    runs = np.diff(np.r_[cut, len(at)])
    data, kinds = blob.tobytes(), {}
    a, b = at[cut].tolist(), (at[cut] + runs + length - 1).tolist()
    of = np.fromiter((kinds.setdefault((k, data[x:y]), len(kinds)) for k, x, y in
                      zip(key[cut].tolist(), a, b, strict=True)), np.int64, len(cut))
    return kinds, of, cut, runs


def smallest(blob: np.ndarray, sizes: np.ndarray, keys: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each window of the segments (one after the other in ``blob``) the smallest doc_id of its string."""
    # equal segments collapse; one that is alone under its key shares its windows with no other
    data, found = blob.tobytes(), {}
    ends = np.cumsum(sizes)
    of = np.fromiter((found.setdefault((k, data[a:b]), len(found)) for k, a, b in
                      zip(keys.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)), np.int64, len(sizes))
    low = np.full(len(found), LAST)
    np.minimum.at(low, of, least)
    key = np.fromiter((k for k, _ in found), np.uint64, len(found))
    size = np.fromiter((len(s) for _, s in found), np.int64, len(found))
    n = size - length + 1
    value = np.repeat(low, n)
    begin = np.cumsum(n) - n
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    if len(some := np.flatnonzero(times[inverse] > 1)):
        names = list(found)
        value[ragged(begin[some], n[some])] = among(
            np.frombuffer(b"".join(names[i][1] for i in some.tolist()), np.uint8), size[some], key[some], low[some], length)
    return value[ragged(begin[of], n[of])]


def among(blob: np.ndarray, sizes: np.ndarray, keys: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """``smallest`` of distinct segments, several of each key."""
    begin = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    entry = np.repeat(np.arange(len(sizes)), n)
    at = ragged(begin, n)
    out = least[entry].copy()
    if not len(at):
        return out
    h = hashes(blob, length, at) ^ mixed(keys)[entry]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    at, entry, window = at[again], entry[again], np.flatnonzero(again)
    if not len(at):
        return out
    # consecutive windows that occur again, as segments of their own; equal ones collapse
    parts, key = np.r_[True, (at[1:] != at[:-1] + 1) | (entry[1:] != entry[:-1])], keys[entry]
    kinds, of, cut, runs = collapsed(blob, at, parts, key, length)
    held: dict[int, int] = {}
    for k, s in kinds:
        held[k] = held.get(k, 0) + len(s)
    if long := {k: n for k, n in held.items() if n > STRING}:
        # anchors with many variants: window by window, dealt out by the windows' hash
        names = np.sort(np.fromiter(long, np.uint64, len(long)))
        much = np.fromiter((long[int(k)] for k in names), np.int64, len(long))
        place = np.minimum(np.searchsorted(names, key), len(names) - 1)
        big = names[place] == key
        pieces = (much[place] // STRING + 1).astype(np.uint64)
        key = np.where(big, mixed(key ^ mixed(h[again] % pieces)), key)
        kinds, of, cut, runs = collapsed(blob, at, parts | big, key, length)
    low = np.full(len(kinds), LAST)
    np.minimum.at(low, of, least[entry[cut]])
    texts = [s for _, s in kinds]
    kind_key = np.fromiter((k for k, _ in kinds), np.uint64, len(kinds))
    order = np.argsort(kind_key, kind="stable")
    # a string for each key: its kinds with a separator after each, and a last symbol
    new = np.r_[True, kind_key[order][1:] != kind_key[order][:-1]]
    lengths = np.fromiter((len(texts[k]) for k in order.tolist()), np.int64, len(order))
    last = np.r_[new[1:], True]
    sized = lengths + 1 + last
    place = np.cumsum(sized) - sized            # of each kind
    symbols = np.zeros(int(sized.sum()), np.int64)
    raw = np.frombuffer(b"".join(texts[k] for k in order.tolist()), np.uint8)
    symbols[ragged(place, lengths)] = raw.astype(np.int64) + 2
    symbols[place + lengths] = 1
    first = place[new]
    # strings of one kind need no sorting: no string of theirs but in that kind
    alone = np.diff(np.r_[np.flatnonzero(new), len(order)]) == 1
    size = np.diff(np.r_[first, len(symbols)])
    value = np.full(len(symbols), LAST)         # by window start
    windows = lengths - length + 1
    starts = ragged(place, windows)
    value[starts] = np.repeat(low[order], windows)
    sortable = np.flatnonzero(~alone)
    todo = ragged(first[sortable], size[sortable])
    if len(todo):
        offsets = np.cumsum(size[sortable]) - size[sortable]
        sa = todo[suffix_arrays(symbols[todo], offsets)]
        is_window = np.zeros(len(symbols), bool)
        is_window[starts] = True
        sa = sa[is_window[sa]]
        begins = np.flatnonzero(~equal_runs(symbols, sa, length))
        value[sa] = np.repeat(np.minimum.reduceat(value[sa], begins), np.diff(np.r_[begins, len(sa)]))
    kind_at = np.empty(len(order), np.int64)
    kind_at[order] = place
    out[window] = value[ragged(kind_at[of], runs)]
    return out


# ---- the jobs

def mark_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus ``removed`` (array of [start, end) byte spans) and ``kept`` (the bytes left)."""
    need(docs, "doc_id", "text")
    names = {c: spare(docs, c) for c in ("removed", "kept")}
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, math.ceil(total / SHARD_BYTES)))

    def read(table: pa.Table) -> tuple[Runs, np.ndarray]:
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        ids = table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        return Runs(texts, length, gram), ids

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "text", block_bytes):
            key, count, shard = anchors(*read(table), shards)
            used, at, ends = stretches(shard)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int32()),
                pa.array([pack_numbers(np.diff(key[a:b] & LOW, prepend=np.uint64(0))) for a, b in
                          zip(at, ends, strict=True)], pa.binary()),
                pa.array([pack_numbers(count[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())],
                names=["block", "shard", "anchors", "counts"])

    @frugal_group
    def count(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack_numbers(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("anchors")]
        counts = np.concatenate([unpack_numbers(x.as_py(), np.uint8) for x in table.column("counts")])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        held = np.bincount(inverse, weights=counts)[inverse]
        code = (held >= 2).astype(np.uint8) + (held >= hot)
        parts = np.split(code, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table.column("block"), "kind": table.column("shard"),
                         "rows": pa.array([pack_numbers(x) for x in parts], pa.binary())})

    @frugal
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "text", block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()),
                                              pa.array([to_bytes(table)], pa.binary())],
                                             names=["block", "kind", "rows"])

    def open_block(table: pa.Table) -> tuple:
        """The runs of a block, its doc_ids and the code of each run."""
        parts = dict(zip(table.column("kind").to_pylist(), table.column("rows").to_pylist(), strict=True))
        runs, ids = read(from_bytes(parts.pop(-1)))
        key, of = np.unique(runs.key, return_inverse=True)
        code = np.concatenate([unpack_numbers(parts[k], np.uint8) for k in sorted(parts)] or [np.zeros(0, np.uint8)])
        if len(code) != len(key):
            raise RuntimeError("the input's rows differ between scans; write it as a table first")
        of_key = np.empty(len(key), np.uint8)
        of_key[in_shard_order(key, shards)[0]] = code
        return runs, ids, of_key[of]

    @frugal_group
    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        runs, ids, code = open_block(table)
        texts, keys, least, (of, _, start, n) = segments(runs, ids, code)
        shard = dealt(keys, shards)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(texts), np.int64)
        place[order] = np.arange(len(texts))
        mark = xxhash.xxh3_64_digest(runs.data)
        by_start = np.argsort(start, kind="stable")
        own = pack([mark, pack_numbers(place[of][by_start].astype(np.uint32)),
                    pack_numbers(np.diff(start[by_start], prepend=0)), pack_numbers(n[by_start].astype(np.uint16))])
        used, at, ends = stretches(shard[order])
        parts = [order[a:b] for a, b in zip(at, ends, strict=True)]
        return pa.table({       # the last row is the block's own and takes no shard's place
            "block": pa.array([block] * (len(used) + 1), pa.int64()),
            "shard": pa.array([*used.tolist(), -1 - block], pa.int64()),
            "keys": pa.array([*(pack_numbers(keys[x]) for x in parts), None], pa.binary()),
            "least": pa.array([*(pack_numbers(least[x]) for x in parts), None], pa.binary()),
            "sizes": pa.array([*(pack_numbers(np.fromiter((len(texts[i]) for i in x.tolist()), np.uint16, len(x)))
                                 for x in parts), None], pa.binary()),
            "texts": pa.array([*(compressed(b"".join(texts[i] for i in x.tolist())) for x in parts), None], pa.binary()),
            "own": pa.array([*[None] * len(used), own], pa.binary())})

    @frugal_group
    def solve(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:        # passes through to its block
            return table.select(["block", "shard", "texts", "own"]).rename_columns(["block", "shard", "gain", "own"])
        column = lambda name, kind: [unpack_numbers(x.as_py(), kind) for x in table.column(name)]
        sizes = [x.astype(np.int64) for x in column("sizes", np.uint16)]
        blob = np.frombuffer(b"".join(expanded(x.as_py()) for x in table.column("texts")), np.uint8)
        least = np.concatenate(column("least", np.int64))
        every = np.concatenate(sizes)
        found = smallest(blob, every, np.concatenate(column("keys", np.uint64)), least, length)
        # most windows are as small as their segment: the difference compresses
        gain = np.repeat(least, every - length + 1) - found
        per = np.cumsum([int((x - length + 1).sum()) for x in sizes])[:-1]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"),
                         "gain": pa.array([pack_numbers(x) for x in np.split(gain, per)], pa.binary()),
                         "own": pa.nulls(table.num_rows, pa.binary())})

    @frugal_pair
    def cut(held: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("gain").to_pylist(), strict=True))
        own = answers.column("own").drop_null()
        at = pa.compute.index(held.column("kind"), -1).as_py()
        if at < 0 or len(own) != 1:
            raise RuntimeError("the input's rows differ between scans; write it as a table first")
        rows = from_bytes(held.column("rows")[at].as_py())
        texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        mark, of, start, n = unpack(own[0].as_py())
        of, start, n = (unpack_numbers(x, k).astype(np.int64) for x, k in ((of, np.uint32), (start, np.int64), (n, np.uint16)))
        start = np.cumsum(start)
        ids = rows.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        # the segments as they were sent, by shard: their windows and smallest doc_ids
        windows = np.zeros(int(of.max()) + 1 if len(of) else 0, np.int64)
        windows[of] = n
        gain = np.concatenate([unpack_numbers(got[s], np.int64) for s in sorted(got) if s >= 0] or [np.zeros(0, np.int64)])
        if mark != xxhash.xxh3_64_digest(data) or len(gain) != int(windows.sum()):
            raise RuntimeError("the input's rows differ between scans; write it as a table first")
        id_of = ids[np.searchsorted(ends, start, side="right")]
        least = np.full(len(windows), LAST)
        np.minimum.at(least, of, id_of)
        low = np.repeat(least, windows) - gain
        place = np.cumsum(windows) - windows
        gone = low[ragged(place[of], n)] < np.repeat(id_of, n)
        at = ragged(start, n)[gone]
        step = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + length, minlength=len(data) + 1)
        covered = np.cumsum(step[:-1]) > 0
        removed, kept = [], []
        for t, b in zip(texts, ends.tolist(), strict=True):
            a = b - len(t)
            own = covered[a:b]
            if not own.any():
                removed.append([])
                kept.append(t)
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            removed.append(edges.reshape(-1, 2).tolist())
            kept.append(data[a:b][~own].tobytes())
        return (rows.append_column(names["removed"], pa.array(removed, pa.list_(pa.list_(pa.int64()))))
                .append_column(names["kept"], pa.array(kept, pa.binary())))

    held = docs.mapInArrow(put, "block long, kind int, rows binary")
    codes = (docs.select("doc_id", "text").mapInArrow(ask, "block long, shard int, anchors binary, counts binary")
             .groupBy("shard").applyInArrow(count, "block long, kind int, rows binary").checkpoint())
    slim = docs.select("doc_id", "text").mapInArrow(put, "block long, kind int, rows binary")
    sent = slim.unionByName(codes).groupBy("block").applyInArrow(
        send, "block long, shard long, keys binary, least binary, sizes binary, texts binary, own binary")
    solved = sent.groupBy("shard").applyInArrow(solve, "block long, shard long, gain binary, own binary")
    schema = (StructType(list(docs.schema)).add(names["removed"], ArrayType(ArrayType(LongType())))
              .add(names["kept"], BinaryType()))
    # with the codes, though only the documents are read here: of plain ``docs`` this is send's exchange again
    return (held.unionByName(codes).groupBy("block").cogroup(solved.groupBy("block"))
            .applyInArrow(cut, schema))


def compressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 3)


def expanded(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    found = mark_repeats(docs.select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"),
                        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
