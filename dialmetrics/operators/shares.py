"""Shares of a total (W03-W06) and category order.

A share ``x / sum(x) over group`` is computed as an aggregation of the group
totals joined back on the group keys (null-safe, since a missing key is a
group of its own), not as a window: the totals are combined map-side, and the
join back is broadcast by AQE when the measured totals are small, so no group's
rows ever have to meet in one task -- a single selected segment with millions of
distinct attempt sequences stays spread over all tasks.

The grand total (no group keys) is by default a scalar subquery: a distributed
aggregate whose single value is inlined into the rows, with no window and no
join. A caller whose input is bounded by a small key cardinality can ask for a
key-less window instead, which saves the second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S

_TOT = "_dm_total"


def _with_total(df: DataFrame, x: str, within, grand: str = "subquery") -> DataFrame:
    """``df`` plus column ``_dm_total`` = sum of ``x`` over the ``within`` group,
    missing where one of the group's values is (V1).

    Grand total (``within`` empty): ``grand="subquery"`` aggregates it in a scalar
    subquery, safe at any size but a second pass over the input;
    ``grand="window"`` is a window without keys, one pass but one task, for
    inputs whose row count is bounded by a small key cardinality.
    """
    within = list(within)
    if not within:
        if grand == "window":
            w = Window.partitionBy()
            whole = F.count(F.col(x)).over(w) == F.count(F.lit(1)).over(w)
            return df.withColumn(_TOT, F.when(whole, F.sum(F.col(x)).over(w)))
        return df.withColumn(_TOT, df.select(S.r_sum(x)).scalar())
    keys = {k: f"_dm_k{i}" for i, k in enumerate(within)}
    totals = df.groupBy(*within).agg(S.r_sum(x).alias(_TOT))
    totals = totals.select(*[F.col(k).alias(a) for k, a in keys.items()], _TOT)
    cond = [df[k].eqNullSafe(totals[a]) for k, a in keys.items()]
    return df.join(totals, cond, "left").drop(*keys.values())


def _finish(df: DataFrame, num: str, out: str, digits, scale: float) -> DataFrame:
    v = S.ratio(num, _TOT)
    if scale != 1.0:
        v = v * scale
    if digits is not None:
        v = S.round_k(v, digits)
    return df.withColumn(out, v).drop(_TOT)


def with_share(df: DataFrame, x: str, within, out: str, digits: int | None = 2,
               scale: float = 1.0, grand: str = "subquery") -> DataFrame:
    """``out = round(x / sum(x) over within * scale, digits)``; ``x`` a whole number."""
    return _finish(_with_total(df, x, within, grand), x, out, digits, scale)


def hundredths(x) -> Column:
    """A value rounded to 2 decimals as a whole number of hundredths.

    It stays a double: sums of whole numbers are exact up to 2^53, and NaN and
    Infinity (a share of zero hours) pass through as they do in R.
    """
    return F.rint(S._c(x).cast("double") * 100)


def with_exact_share_of_rounded(df: DataFrame, x: str, within, out: str,
                                digits: int | None = 2, scale: float = 1.0) -> DataFrame:
    """Share of a value that is itself rounded to 2 decimals (hours, shares).

    The sum is taken over whole hundredths, so it is exact and does not depend
    on the order in which rows meet; the share is then one division.
    """
    h = "_dm_h"
    out_df = _finish(_with_total(df.withColumn(h, hundredths(x)), h, within), h, out, digits, scale)
    return out_df.drop(h)


def category_order(df: DataFrame, category: str, value: str, out: str = "cat_order") -> DataFrame:
    """A08 (``reorder(category, value)``): rank of each category by the mean of
    ``value`` (a 2-decimal share), ascending, ties by name. A missing category is
    no level: the others are ranked without it, and it stands last.

    Means are aggregated per category (an exact mean of whole hundredths), ranked
    on that small table (finish-code categories: at most 7 plus missing), and
    joined back.
    """
    means = df.groupBy(category).agg(
        (F.sum(hundredths(value)) / F.count(F.lit(1))).alias("_dm_mean"))
    rank_w = Window.orderBy(F.col(category).isNull(), F.col("_dm_mean").asc(), F.col(category).asc_nulls_last())
    ranks = means.select(F.col(category).alias("_dm_cat"),
                         F.dense_rank().over(rank_w).cast("int").alias(out))
    return (df.join(ranks, df[category].eqNullSafe(ranks["_dm_cat"]), "left")
            .drop("_dm_cat"))
