"""SimHash near-duplicates by a forest of vantage-point trees.

Fingerprints. A text's words (split at ASCII white space, A-Z lower-cased) give
shingles of ``shingle`` words, repeats included; a bit of the 64-bit fingerprint
is 1 where it is set in more than half of the shingles' hashes (XXH64, seed 42).

Links: fingerprints that differ in at most ``max_bits`` bits. Distances of
64-bit fingerprints crowd around 32, and against a bound of 4 one tree over all
bits prunes little. So there are ``TREES`` trees, each over its own part of the
bits. If two fingerprints differ in at most ``max_bits`` bits, they differ in at
most ``radius = max_bits // TREES`` bits in one of the parts, so every link shows
in one of the trees within that radius.

A tree partitions its fingerprints level by level into shells of Hamming
distance to the level's vantage point. A level's distance counts the bits of its
own share of the tree's part, so by the triangle inequality
``sum over levels |d(q, vp) - d(x, vp)| <= distance(q, x)``: a fingerprint needs
its own cell and the cells whose shells are off by at most ``radius`` in total;
all other branches are pruned. It lives in its own cell and visits, as a query,
the neighbouring cells on one side (the other side visits it). The number of
levels follows from the number of fingerprints, so that cells stay small; any
number gives the same links.

Cells are hashed into shards, which compare within their cells exactly and emit
no pairs, but for each cell the members of linked groups with the group's least
fingerprint; components.py joins these. Equal fingerprints are one node, so
copies never meet. A cell of more than ``CELL_ROWS`` fingerprints is cut into
slices, and each pair of slices is a piece of work of its own.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; null doc_ids link, but are no component's id while it has another;
repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .components import components
from .text import need, spare

SHINGLE = 4
MAX_BITS = 4
TREES = 3
CELL_ROWS = 30_000      # fingerprints of a cell that one piece of work compares
CELL_MEAN = 64          # fingerprints of a cell, on average, that the depth aims at
SHARD_ROWS = 200_000    # rows of a shard, on average
VANTAGE = 0x9E3779B97F4A7C15    # vantage points: multiples of this odd number
WORDS_AT_ONCE = 65_536
BROADCAST_MARKS = 500_000       # documents that go (two longs each) that may be broadcast; beyond, a shuffle join


# ---- fingerprints

def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; words are taken some at a time, so a text may be long."""
    counts, n, kept, rest, first = np.zeros(64, np.int64), 0, [], text.lower(), True
    while rest is not None:
        got = rest.split(None, WORDS_AT_ONCE)
        rest = got.pop() if len(got) > WORDS_AT_ONCE else None
        words = kept + got
        if len(words) < shingle and (not first or rest is not None):
            kept = words
            continue
        if not words:
            break
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        k = min(shingle, len(words))
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in
                           zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
        kept, first = words[len(words) - k + 1:] if k > 1 else [], False
    on = counts * 2 > n
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, out: str = "fp", shingle: int = SHINGLE, drop_text: bool = False) -> DataFrame:
    """``docs`` plus the fingerprint as a signed long (``drop_text`` leaves the text out)."""
    need(docs, "text")
    kept = [c for c in docs.columns if not (drop_text and c == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash((t.as_py() or "").encode(), shingle) for t in batch.column("text")),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found.view(np.int64))],
                                             names=[*kept, out])

    return docs.mapInArrow(run, docs.select(*kept, F.lit(0).cast("long").alias(out)).schema)


# ---- trees

def parts(trees: int, levels: int) -> list[list[list[int]]]:
    """The bits of each level of each tree."""
    bounds = [round(64 * t / trees) for t in range(trees + 1)]
    out = []
    for a, b in itertools.pairwise(bounds):
        n = min(levels, b - a)
        cuts = [a + round((b - a) * i / n) for i in range(n + 1)]
        out.append([list(range(x, y)) for x, y in itertools.pairwise(cuts)])
    return out


def meet(bits: int) -> float:
    """The chance that two random fingerprints have equal distances to a vantage point over so many bits."""
    return math.comb(2 * bits, bits) / 4.0 ** bits


def depth(n: int, trees: int = TREES, mean: int = CELL_MEAN) -> int:
    """The least number of levels at which a cell holds ``mean`` of n fingerprints at most."""
    most = 64 // trees
    for levels in range(2, most):
        cells = max(math.prod(meet(len(bits)) for bits in tree) for tree in parts(trees, levels))
        if n * cells <= mean:
            return levels
    return most


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def visits(fps: DataFrame, max_bits: int, trees: int, levels: int) -> DataFrame:
    """``fp, tree, cell, home``: the cell of each fingerprint in each tree and the cells that it visits."""
    radius, targets = max_bits // trees, []
    for t, tree in enumerate(parts(trees, levels)):
        shells: list[Column] = []
        for j, bits in enumerate(tree):
            mask = sum(1 << b for b in bits)
            vantage = (VANTAGE * (t * 64 + j + 1)) & mask
            shells.append(F.bit_count(F.col("fp").bitwiseAND(F.lit(signed(mask))).bitwiseXOR(F.lit(signed(vantage)))))
        scales = [1]
        for bits in tree[:-1]:
            scales.append(scales[-1] * (len(bits) + 1))
        cell = sum((d.cast("long") * s for d, s in zip(shells, scales, strict=True)), F.lit(0).cast("long"))
        targets.append(F.array(F.struct(F.lit(t).alias("tree"), cell.alias("cell"), F.lit(True).alias("home"))))
        for offset in offsets(len(tree), radius):
            inside = F.lit(True)
            for d, o, bits in zip(shells, offset, tree, strict=True):
                if o:
                    inside = inside & (d + o).between(0, len(bits))
            there = cell + sum(o * s for o, s in zip(offset, scales, strict=True))
            targets.append(F.when(inside, F.array(F.struct(F.lit(t).alias("tree"), there.alias("cell"),
                                                           F.lit(False).alias("home"))))
                           .otherwise(F.array().cast("array<struct<tree:int,cell:long,home:boolean>>")))
    return fps.select("fp", F.explode(F.concat(*targets)).alias("x")).select("fp", "x.tree", "x.cell", "x.home")


def offsets(levels: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Shell offsets of at most ``radius`` in total whose first nonzero entry is positive."""
    def part(left: int, radius: int, started: bool) -> Iterator[tuple[int, ...]]:
        if not left:
            if started:
                yield ()
            return
        for o in range(-radius if started else 0, radius + 1):
            for more in part(left - 1, radius - abs(o), started or o != 0):
                yield (o, *more)
    return part(levels, radius, False)


# ---- shards

def groups(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, side: np.ndarray, max_bits: int,
           long_run: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Members of linked groups and their groups' least fingerprints, cell by cell.

    Two visitors of a cell are not compared (their own cells' trees see to that), nor
    are two rows of one slice where the piece of work is a pair of slices.
    """
    order = np.lexsort((fp, cell))
    cell, fp, home, side = cell[order], fp[order], home[order], side[order]
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    label, bits = np.arange(n), fp.view(np.uint64)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
        return near & (home[i] | home[j]) & ((side[i] != side[j]) | (side[i] < 0))

    left = np.repeat(ends, ends - starts) - np.arange(n) - 1
    left[np.repeat(ends - starts, ends - starts) > long_run] = 0
    at, shift, pairs = np.flatnonzero(left > 0), 1, []
    while len(at):
        near = at[linked(at, at + shift)]
        pairs.append((near, near + shift))
        shift += 1
        at = at[left[at] >= shift]
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not np.array_equal(label, label[label]):
                label = label[label]
    for a, b in zip(starts, ends, strict=True):
        if b - a > long_run:
            own = label[a:b]
            for i in range(a, b - 1):
                j = np.arange(i + 1, b)
                other = own[j[linked(np.full(len(j), i), j)] - a]
                meet_at = np.unique(other[other != own[i - a]])
                if len(meet_at):
                    joined = np.append(meet_at, own[i - a])
                    own[np.isin(own, joined)] = joined.min()
    size = np.bincount(label, minlength=n)
    some = size[label] > 1
    return fp[some], fp[label[some]]


def pieces_of_work(rows: DataFrame, cell: tuple[str, ...], item: str, cell_rows: int, rows_bound: int) -> DataFrame:
    """``rows`` plus ``work``, what compares its rows with each other, and ``side``.

    A cell is one piece (side -1). One of more than ``cell_rows`` rows is cut into
    slices by a hash of the item; each pair of slices is a piece, in which rows are
    compared with rows of the other side, and each slice by itself (side -1) one more.
    ``rows_bound``: about how many rows there are.
    """
    whole = F.xxhash64(*cell)
    # a cell of that size needs a bin of that size; few numbers tell that there is none
    bins = max(1 << 16, 128 * (rows_bound // cell_rows))
    full = (rows.groupBy(F.pmod(whole, F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > cell_rows))
    if full.isEmpty():
        return rows.withColumn("work", whole).withColumn("side", F.lit(-1))
    names = {c: spare(rows, f"cell_{c}") for c in cell}
    # at most rows / cell_rows cells
    large = (rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
             .select(*[F.col(c).alias(n) for c, n in names.items()],
                     F.ceil(F.col("n") / cell_rows).cast("int").alias("slices")))
    same = [rows[c] == large[n] for c, n in names.items()]
    rows = rows.join(large, same, "left").drop(*names.values())
    own = F.when(F.col("slices").isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(item), F.col("slices")).cast("int"))
    other = F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(-1)))
                      .otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("slice", own).withColumn("other", other)
    work = F.xxhash64(*cell, F.least("slice", "other"), F.greatest("slice", "other"))
    side = F.when(F.col("slice") == F.col("other"), -1).otherwise(F.col("slice"))
    return rows.withColumn("work", work).withColumn("side", side).drop("slices", "slice", "other")


def link(fps: DataFrame, max_bits: int = MAX_BITS, trees: int = TREES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``node, label``: memberships in linked groups of the distinct fingerprints ``fp``."""
    n = fps.count()
    levels = depth(n, trees)
    per_row = trees * (1 + sum(1 for _ in offsets(levels, max_bits // trees)))
    rows = pieces_of_work(visits(fps, max_bits, trees, levels), ("tree", "cell"), "fp", cell_rows, n * per_row)
    shards = max(1, math.ceil(n * per_row / SHARD_ROWS))
    rows = rows.select("fp", "home", "work", "side", F.pmod("work", F.lit(shards)).alias("shard"))

    def search(table: pa.Table) -> pa.Table:
        node, label = groups(table["work"].to_numpy(), table["fp"].to_numpy(), table["home"].to_numpy(),
                             table["side"].to_numpy(), max_bits)
        return pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(label, pa.int64())})

    return rows.groupBy("shard").applyInArrow(search, "node long, label long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    trees: int = TREES) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for each row of ``doc_id, text``.

    ``root`` is a fingerprint that stands for the component, ``component_id`` its smallest doc_id.
    """
    need(docs, "doc_id", "text")
    ensure_checkpoint_dir(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = with_fingerprint(own, "fp", shingle, drop_text=True).checkpoint()
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    found = components(link(least.select("fp"), max_bits, trees)).checkpoint()
    each = least.join(found, least["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = each.groupBy("root").agg(F.min("least").alias("component_id"))
    # one row for each fingerprint; rows of a common one are split by the planner
    of = each.join(ids, "root").select(F.col("fp").alias("node"), "root", "component_id").checkpoint()
    return rows.join(of, rows["fp"] == of["node"]).drop("node")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with its columns: the smallest doc_id's (null last), of these
    the smallest text hash's. Of rows that repeat both, one stays (any: they are the same document)."""
    need(docs, "doc_id", "text")
    found = near_duplicates(docs.select("doc_id", "text"), shingle, max_bits)
    each = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    best = each.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("root").alias("r"), "best")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # the documents that go, and of those that stay the ones with repeated rows
    names = {c: spare(docs, f"near_{c}") for c in ("id", "hash", "goes")}
    marks = (each.join(best, each["root"] == best["r"]).where(~kept | (F.col("n") > 1))
             .select(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"]),
                     (~kept).alias(names["goes"])).checkpoint())
    side = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    same = (docs["doc_id"].cast("long").eqNullSafe(side[names["id"]])
            & (F.xxhash64(docs["text"]) == side[names["hash"]]))
    repeats = marks.where(~F.col(names["goes"]))
    out = docs.join(side, same, "left_anti")
    if not repeats.isEmpty():
        again = docs.join(repeats, docs["doc_id"].cast("long").eqNullSafe(repeats[names["id"]])
                          & (F.xxhash64(docs["text"]) == repeats[names["hash"]]), "left_semi")
        key = spare(docs, "near_key")
        out = out.unionByName(again.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key))
    return out
