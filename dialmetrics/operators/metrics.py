"""Metric blocks shared by many reports.

Each block is one ``groupBy().agg()`` (partial aggregation before the shuffle,
so a hot segment or week is combined map-side) followed by row-wise ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S

BENEFIT_RATIOS = ["conversion", "sales_to_dials", "sales_to_connects", "avg_dials"]


# A frame may be a table of attempts or a base of them (lattice.py): rows that stand for
# ``_n`` attempts each, equal in all their other columns. The measures below read both.
WEIGHT, LENGTH, TIMED = "_n", "_length", "_length_n"


def rows_in(df: DataFrame) -> Column:
    """Number of attempts, as an aggregate."""
    return F.coalesce(F.sum(WEIGHT), F.lit(0)) if WEIGHT in df.columns else F.count(F.lit(1))


def total(df: DataFrame, x: str) -> Column:
    """R sum of a column over attempts: missing as soon as one value is missing, 0 over no rows."""
    if WEIGHT not in df.columns:
        return S.r_sum(x)
    known, value = (F.col(TIMED), F.col(LENGTH)) if x == "length" else (
        F.when(F.col(x).isNotNull(), F.col(WEIGHT)).otherwise(0), F.col(x) * F.col(WEIGHT))
    return F.when(F.coalesce(F.sum(known), F.lit(0)) == rows_in(df), F.coalesce(F.sum(value), F.lit(0)))


def count_rows(df: DataFrame, keys, name: str = "rows") -> DataFrame:
    """Rows per key combination."""
    return df.groupBy(*keys).agg(rows_in(df).alias(name))


def _benefit_counts(df: DataFrame, case: str):
    return [S.r_n_distinct(case).alias("records"),
            rows_in(df).alias("attempts"),
            total(df, "is_contact").alias("contacts"),
            total(df, "is_sale").alias("sales")]


def benefit_ratios(agg: DataFrame) -> DataFrame:
    """The four 2-decimal ratios of the benefit block, from its four counts."""
    return agg.withColumns({
        "conversion": S.round_k(S.ratio("sales", "records") * 100, 2),
        "sales_to_dials": S.round_k(S.ratio("sales", "attempts") * 100, 2),
        "sales_to_connects": S.round_k(S.ratio("sales", "contacts") * 100, 2),
        "avg_dials": S.round_k(S.ratio("attempts", "records"), 2),
    })


def benefit(df: DataFrame, keys, case: str = "id") -> DataFrame:
    """Records (distinct cases), attempts, contacts, sales and four ratios.

    ``conversion = sales/records*100``, ``sales_to_dials = sales/attempts*100``,
    ``sales_to_connects = sales/contacts*100``, ``avg_dials = attempts/records``,
    all rounded half-even to 2 decimals. ``keys=[]`` gives one overall row.
    """
    return benefit_ratios(df.groupBy(*keys).agg(*_benefit_counts(df, case)))


def benefit_sets(df: DataFrame, grains, case: str = "id") -> DataFrame:
    """The benefit counts for several key sets from one read of the input.

    Distinct cases add up exactly: cases are kept as bitmaps, one 64-bit word for
    each run of 64 ids in which some case occurs (``bit_or``; a hash aggregation with a
    buffer of fixed size, and never more rows than cases). First one row for each
    combination of all keys and word; the key sets (GROUPING SETS) then merge words of
    that, and a set's records are the bits of its words. A missing case is one more
    value. ``_gid`` tells the sets apart (a missing key value stays distinct from a
    rolled-up column); pick one with ``benefit_grain``.
    """
    grains = [list(g) for g in grains]
    cols = list(dict.fromkeys(c for g in grains for c in g))
    word, bit = F.shiftright(case, 6), (F.col(case).bitwiseAND(F.lit(63))).cast("int")
    fine = (df.withColumn("_word", word).groupBy(*cols, "_word")
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_mask"),
                 F.count(F.lit(1)).alias("_rows"),
                 *[x for c in ("is_contact", "is_sale")
                   for x in (F.count(c).alias(f"_{c}_n"), F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}"))]))
    merged = (fine.groupingSets([[*g, "_word"] for g in grains], *cols, "_word")
              .agg(F.bit_or("_mask").alias("_mask"), F.grouping_id().alias("_gid"),
                   *[F.sum(c).alias(c) for c in ("_rows", "_is_contact_n", "_is_contact", "_is_sale_n", "_is_sale")]))
    # the missing case has a word of its own (null), whose mask is null
    records = F.sum(F.coalesce(F.bit_count("_mask"), F.lit(1)))

    def known(c):
        return F.when(F.sum(f"_{c}_n") == F.sum("_rows"), F.sum(f"_{c}"))

    return (merged.groupBy(*cols, F.shiftright("_gid", 1).alias("_gid"))     # _word is the last bit, never rolled up
            .agg(records.cast("long").alias("records"), F.sum("_rows").alias("attempts"),
                 known("is_contact").alias("contacts"), known("is_sale").alias("sales")))


def benefit_grain(sets: DataFrame, grains, i: int) -> DataFrame:
    """The benefit block (counts and ratios) of key set ``grains[i]`` from ``benefit_sets``."""
    cols = list(dict.fromkeys(c for g in grains for c in g))
    keys = list(grains[i])
    gid = sum(1 << (len(cols) - 1 - j) for j, c in enumerate(cols) if c not in keys)
    picked = sets.where(F.col("_gid") == gid).select(*keys, "records", "attempts", "contacts", "sales")
    return benefit_ratios(picked)


def contact_sale_counts(df: DataFrame, keys, names=("attempts", "contacts", "sales")) -> DataFrame:
    """Attempts (rows), contacts and sales (R sums) per key combination."""
    a, c, s = names
    return df.groupBy(*keys).agg(
        rows_in(df).alias(a),
        total(df, "is_contact").alias(c),
        total(df, "is_sale").alias(s),
    )


def with_rates(agg: DataFrame, scale: float = 1.0, digits: int | None = 2,
               names=("attempts", "contacts", "sales", "contact_perc", "sales_perc")) -> DataFrame:
    """Add contacts/attempts and sales/contacts to an aggregate of those counts."""
    a, c, s, cp, sp = names
    cr = S.ratio(c, a) * scale if scale != 1.0 else S.ratio(c, a)
    sr = S.ratio(s, c) * scale if scale != 1.0 else S.ratio(s, c)
    if digits is not None:
        cr, sr = S.round_k(cr, digits), S.round_k(sr, digits)
    return agg.withColumns({cp: cr, sp: sr})


def contact_sale_rates(df: DataFrame, keys, scale: float = 1.0, digits: int | None = 2,
                       names=("attempts", "contacts", "sales", "contact_perc", "sales_perc")) -> DataFrame:
    """Attempts, contacts, sales and the two rates contacts/attempts, sales/contacts.

    ``scale=100`` gives percents; ``digits=None`` leaves the rates unrounded.
    """
    return with_rates(contact_sale_counts(df, keys, names[:3]), scale, digits, names)


def talk_time(df: DataFrame, keys, hours: str = "hours") -> DataFrame:
    """Talk hours (2 decimals), sales, and sales per (rounded) hour."""
    agg = df.groupBy(*keys).agg(
        S.round_k(S.ratio(total(df, "length"), F.lit(3600)), 2).alias(hours),
        total(df, "is_sale").alias("sales"),
    )
    return agg.withColumn("sales_hour", S.round_k(S.ratio("sales", hours), 2))
