"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws an
exponential variate ``-ln(u) / weight`` from a hash of the document's key and
the child's path, and the smallest draw wins: a child gets documents in
proportion to its weight, and a changed weight moves documents only into or out
of that child. The law is ``key``: doc_id and the shard count alone decide.

Growth. A plain descent would let documents that a heavier region wins spread
over all its racks. So weight that is added later stays a ticket of its own: the
base tree competes at the top level through its regions, and every later shard
through a ticket that leads down its path (region / rack / shard) to that shard
alone. One more shard therefore takes documents only into itself, and all other
subtrees, whose weights did not change, keep theirs.

Slots are numbered without bringing a shard into one task: documents are counted
per (shard, bucket), a running sum over the buckets of a shard gives each bucket
its first slot, and only a bucket's documents are numbered in a window. The
bucket is a hash of the key, so ``SLOT_BUCKETS`` bounds a window to
rows / (shards * buckets).

Defined results: a null text has no bytes (size 8, crc of the empty text); rows
without a doc_id use the text as key; repeated rows share a shard and get slots
of their own; an empty table gives an empty table. Copies of a text under other
ids go where their ids go, as the key law asks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import draw, need, spare, utf8

SEED = "shard-1"
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf has a shard number, an inner node has children."""

    name: str
    weight: float = 0.0
    shard: int | None = None
    children: tuple["Node", ...] = ()

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else float(self.weight)


def tree(shards: int, base: int = 24, regions: int = 2, racks: int = 3,
         weights: Sequence[float] | None = None) -> Node:
    """The layout of ``shards`` shards: up to ``base`` in the base tree, later ones as tickets.

    Shard ``i`` of the base lies in region ``i % regions`` and there in rack
    ``i // regions % racks``; a later shard lies in the same place by this rule.
    """
    weight = [1.0] * shards if weights is None else [float(w) for w in weights]
    if len(weight) != shards or shards < 1 or min(weight) <= 0:
        raise ValueError("one positive weight for each shard is needed")

    def place(i: int) -> tuple[int, int]:
        return i % regions, i // regions % racks

    def leaf(i: int) -> Node:
        return Node(f"shard{i}", weight[i], i)

    top = []
    for g in range(regions):
        inner = []
        for k in range(racks):
            leaves = tuple(leaf(i) for i in range(min(base, shards)) if place(i) == (g, k))
            if leaves:
                inner.append(Node(f"rack{k}", children=leaves))
        if inner:
            top.append(Node(f"region{g}", children=tuple(inner)))
    for i in range(base, shards):
        g, k = place(i)
        top.append(Node(f"region{g}+{i}", children=(Node(f"rack{k}", children=(leaf(i),)),)))
    return Node("root", children=tuple(top))


def _levels(df: DataFrame, node: Node, key: Sequence[Column], out: str, seed: str) -> DataFrame:
    """Column ``out`` with the shard that the key reaches, one projection for each level."""
    frontier, won = [("", node)], spare(df, "_hop")
    df = df.withColumn(won, F.lit(""))
    while any(n.children for _, n in frontier):
        hop, following = F.col(won), []
        for path, n in frontier:
            if not n.children:
                following.append((path, n))
                continue
            kids = [(f"{path}/{c.name}", c) for c in n.children]
            following += kids
            draws = [F.struct((-F.log(draw(F.lit(p), *key, seed=seed)) / F.lit(c.total)).alias("e"),
                              F.lit(p).alias("p")) for p, c in kids]
            least = F.array_min(F.array(*draws)).getField("p")
            hop = F.when(F.col(won) == F.lit(path), least).otherwise(hop)
        df, frontier = df.withColumn(won, hop), following
    shard = F.create_map(*[x for p, n in frontier for x in (F.lit(p), F.lit(n.shard))])
    return df.withColumn(out, F.element_at(shard, F.col(won)).cast("int")).drop(won)


def assign(df: DataFrame, layout: Node, out: str = "shard", seed: str = SEED) -> DataFrame:
    """``df`` plus the shard of each row; all other columns pass through."""
    need(df, "doc_id", "text")
    key = (F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))))
    return _levels(df, layout, key, out, seed)


def number_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", out: str = "slot",
                 buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Gapless numbers from 0 within each shard, by bucket and then ``order``."""
    bucket, first = spare(df, "_bucket"), spare(df, "_first")
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each (shard, bucket): at most shards * buckets
    starts = (df.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("n"))
              .select(shard, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)))
    within = Window.partitionBy(shard, bucket).orderBy(*order)
    return (df.withColumn(out, F.row_number().over(within) - 1)
            .join(starts, [shard, bucket])
            .withColumn(out, (F.col(out) + F.col(first)).cast("long"))
            .drop(bucket, first))


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = SEED) -> DataFrame:
    """The contract's columns: where each document of ``doc_id, text`` goes, now and with one more shard."""
    rows = assign(docs.select("doc_id", "text"), tree(shards), "shard", seed)
    rows = assign(rows, tree(shards + 1), "grown_shard", seed)
    rows = rows.select("doc_id", (F.octet_length(utf8("text")) + 8).cast("long").alias("size"),
                       F.crc32(utf8("text")).alias("text_crc32"), F.lit("key").alias("law"),
                       "shard", "grown_shard")
    rows = number_slots(rows, ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
