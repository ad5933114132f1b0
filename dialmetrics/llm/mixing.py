"""Mixing sources to target weights.

Tokens (words) are summed per source; targets are dealt out by weight under a
limit of ``max_rate`` times the source's size (water filling); the repetition
rate of a source is target / size. A document is emitted ``floor(rate)`` times,
plus one hash-seeded Bernoulli copy with probability ``rate - floor(rate)``.

All of it is built-in column functions. The corpus is read twice (sums, then
copies); what moves between tasks is one partial sum per source and task. The
targets, one row per source, are checkpointed and counted: up to
``BROADCAST_SOURCES`` of them are broadcast to the documents, which then stay
where they are; beyond that the join is by shuffle, where the planner splits a
hot source.

Defined results: a null text has 0 words; null sources form one source, last in
order; documents of a source without any word have rate 0 and give no copy
(their target is 0); repeated rows take the same decision; an empty table gives
an empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import draw, need, spare, word_count

WEIGHTS = (5, 2, 1)     # by order of source, repeating
BUDGET = 1.5            # share of all words that the mix takes
MAX_RATE = 2.0          # no source beyond this many times its size
SEED = "mix-1"
BROADCAST_SOURCES = 200_000     # rows of targets (about 100 bytes each) that may be broadcast


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_rate: float = MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from documents with ``source, size``.

    Targets are ``min(limit, level * weight)`` at the level where they add up to
    the budget: what a limited source leaves over is shared again by weight until
    none is above its limit. Sources reach their limits in the order of
    limit / weight, so the level follows from two running sums in that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # key-less windows over one row per source
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    per = (per.withColumn("w", w)
           .withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
           .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget))))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("w").over(onwards))
    # the level once all sources before this one are full; it holds from the first
    # source that it does not fill (if it fills all, every source is at its limit)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    holds = F.first(fits, ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(holds * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def copies(rate: Column, *key, seed: str = SEED) -> Column:
    """``floor(rate)`` plus one with probability ``rate - floor(rate)``, by hash."""
    return (F.floor(rate) + (draw(*key, seed=seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE,
        seed: str = SEED) -> DataFrame:
    """``docs`` plus ``size, source_size, target, copies`` (one row per input row)."""
    need(docs, "doc_id", "text", "source")
    added = {c: spare(docs, f"mix_{c}") for c in ("size", "source_size", "target", "copies")}
    sized = docs.withColumn(added["size"], word_count("text"))
    targets = source_targets(sized.select("source", F.col(added["size"]).alias("size")),
                             weights, budget, max_rate)
    ensure_checkpoint_dir(docs.sparkSession)
    targets = targets.checkpoint()
    few = targets.count() <= BROADCAST_SOURCES
    key = spare(docs, "mix_source")
    targets = targets.select(F.col("source").alias(key),
                             F.col("source_size").alias(added["source_size"]),
                             F.col("target").alias(added["target"]))
    side = F.broadcast(targets) if few else targets
    joined = sized.join(side, sized["source"].eqNullSafe(side[key]), "left").drop(key)
    rate = F.coalesce(F.try_divide(F.col(added["target"]), F.col(added["source_size"])), F.lit(0.0))
    # rows without an id are told apart by their text
    own = F.when(F.col("doc_id").isNull(), F.col("text"))
    return joined.withColumn(added["copies"], copies(rate, F.col("doc_id"), own, seed=seed))


def emit(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the input's rows and columns, each row as often as the mix takes it."""
    mixed = mix(docs, **kw)
    n = mixed.columns[-1]
    again = spare(mixed, "mix_copy")
    return (mixed.where(F.col(n) > 0)
            .withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
            .select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of the mix of ``doc_id, text, source``."""
    m = mix(docs.select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("mix_size").alias("size"),
                    F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"),
                    (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
