"""Connected components of memberships, as Spark jobs.

Input: rows ``(node, label)`` that say node and label belong together, as local
searches emit them (each member of a local group with the group's least member,
itself included). Nodes with several labels join these labels: the graph that is
left has the labels as vertices only, and no group's members meet in one place.
That graph is brought to stars by alternating large-star and small-star rounds;
each round is checkpointed, so that lost executors cost no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the vertex's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are tied to its least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = (edges.join(least, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for each vertex of the edges ``(u, v)``, u > v, but the roots themselves."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges, last = edges.checkpoint(), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            return edges.select("u", F.col("v").alias("root"))
        last = mark
        edges = _small_star(_large_star(edges)).checkpoint()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: for every node of ``links (node, label)`` one label, the same in a component."""
    ensure_checkpoint_dir(links.sparkSession)
    itself = links.select(F.col("label").alias("node"), "label")
    links = links.unionByName(itself).distinct().checkpoint()
    best = links.groupBy("node").agg(F.min("label").alias("best"))
    edges = (links.join(best, "node").where(F.col("label") != F.col("best"))
             .select(F.col("label").alias("u"), F.col("best").alias("v")).distinct())
    found = roots(edges)
    return (best.join(found, best["best"] == found["u"], "left")
            .select("node", F.coalesce("root", "best").alias("root")))
