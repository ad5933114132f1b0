"""

Every report takes the ``attempts`` DataFrame (``operators.derive_attempts``)
and a ``Params`` and returns a DataFrame; nothing is collected. "T" below is
the period filter ``dialer_tweak == 'tweak'``. Only reports whose original
sorts its output (``arrange``) sort here; the rest leave order to the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import derive as D
from ..operators.difference import difference
from ..operators.metrics import (
    BENEFIT_RATIOS, benefit, benefit_grain, benefit_ratios, benefit_sets, contact_sale_rates, count_rows, rows_in,
    talk_time, total, with_rates,
)
from ..operators.numbering import first_attempts, number_attempts, time_order
from ..functions.codes import CODE_CATEGORY
from ..operators.reshape import sequence_text, to_long, to_wide, to_wide_coded
from ..operators.shares import category_order, with_exact_share_of_rounded, with_share
from ..params import Params

# Names given to the first ten attempt columns of the sequence table.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
            "ninth", "tenth"]


# Small aggregates that several reports derive from (as the original reuses
# sales.data for five tables): computed once per attempts DataFrame and kept with
# cache(). They are bounded by key cardinalities (segments x weeks, hours,
# categories, customer attributes); lost blocks are recomputed from lineage. The
# attempts frame is held with them, so nothing stays cached that ``clear_shared``
# does not know; ``shared_aggregates`` bounds their life.
_SHARED: dict[int, tuple[DataFrame, dict]] = {}


def _shared(df: DataFrame, p: Params, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    _, per_df = _SHARED.setdefault(id(df), (df, {}))
    key = (name, p)
    if key not in per_df:
        per_df[key] = build().cache()
    return per_df[key]


def clear_shared() -> None:
    """Unpersist and forget the shared aggregates."""
    for _, per_df in _SHARED.values():
        for cached in per_df.values():
            cached.unpersist()
    _SHARED.clear()


# Whether the reports run as a pack: one that would filter before it aggregates, when it
# runs alone, then takes its rows from the base that the others need anyway.
_pack = [False]


@contextmanager
def shared_aggregates() -> Iterator[None]:
    """Reports computed inside share their aggregates; on leaving, none stays cached."""
    before, _pack[0] = _pack[0], True
    try:
        yield
    finally:
        _pack[0] = before
        clear_shared()


def _tweak(df: DataFrame, p: Params) -> DataFrame:
    """T: ``dialer_tweak == 'tweak'``, written as the equal test on the date
    (a date from the cut on) so it is a partition filter on the stored table."""
    return df.where(F.col("placed_date") >= F.lit(p.cut).cast("date"))


def _text_columns(values) -> list[str] | None:
    """Wide-column names of a number turned into text, in text order (V13);
    None stays None (the values present in the data, already in text order)."""
    return None if values is None else sorted(str(v) for v in values)


# -- P01 and variants -------------------------------------------------------------------

def attempts(df: DataFrame, p: Params) -> DataFrame:
    """The attempts table itself."""
    return df


def extremes(df: DataFrame, p: Params) -> DataFrame:
    """Cases with more than ``extreme_attempts`` attempts, most first per segment."""
    return (count_rows(df, ["segs", "id"], "attempts")
            .where(F.col("attempts") > p.extreme_attempts)
            .orderBy(F.col("segs").asc_nulls_last(), F.col("attempts").desc(), F.col("id")))


# -- benefit tracking (A05) ---------------------------------------------------------------

# P02 and P05-P09 (and, in a pack, P03) come from one read of the attempts: all their key
# sets in one aggregation, distinct cases merged from bitmaps (``benefit_sets``). The result
# is a handful of rows, shared by the family. ``_period`` is T as a key. P03 alone and P04
# filter first and group once.
_GRAINS = {"segs": ["segs"], "cat": ["pilot_cat"], "total": [], "segs_week": ["segs", "placed_week"],
           "t_segs_week": ["segs", "placed_week", "dialer_tweak", "_period"],
           "t_cat_week": ["pilot_cat", "placed_week", "_period"], "t_week": ["placed_week", "_period"]}


def _benefit(df: DataFrame, p: Params, grain: str) -> DataFrame:
    flagged = df if "placed_date" not in df.columns else df.withColumn(
        "_period", F.coalesce(F.col("placed_date") >= F.lit(p.cut).cast("date"), F.lit(False)))
    # the key sets that the frame's columns can give
    grains = {n: g for n, g in _GRAINS.items() if set(g) <= set(flagged.columns) and (_pack[0] or n != "segs_week")}
    sets = _shared(df, p, f"benefit {len(grains)}", lambda: benefit_sets(flagged, grains.values()))
    picked = benefit_grain(sets, list(grains.values()), list(grains).index(grain))
    return picked.where("_period").drop("_period") if "_period" in picked.columns else picked


def benefit_segs(df: DataFrame, p: Params) -> DataFrame:
    """P02."""
    return _benefit(df, p, "segs")


def _segs_weeks_long(df: DataFrame, p: Params) -> DataFrame:
    """``segs, placed_week, key, value``: P03 before it is made wide."""
    chosen = (F.col("placed_week") > p.week_floor) & F.col("segs").isin(*p.segments)
    b = _benefit(df, p, "segs_week").where(chosen) if _pack[0] else benefit(df.where(chosen), ["segs", "placed_week"])
    return to_long(b.select("segs", "placed_week", *BENEFIT_RATIOS), BENEFIT_RATIOS, "key", "value")


def benefit_segs_weeks(df: DataFrame, p: Params) -> DataFrame:
    """Ratios per segment and week, long by ratio, wide by week."""
    weeks = None if p.week_columns is None else [w for w in p.week_columns if w > p.week_floor]
    return to_wide(_segs_weeks_long(df, p), "placed_week", "value", weeks)


def benefit_segs_weeks_diff(df: DataFrame, older: DataFrame, p: Params) -> DataFrame:
    """P03 against P04: what the newer extract changes, per segment, week and ratio."""
    return difference(_segs_weeks_long(df, p), _segs_weeks_long(older, p), ["segs", "placed_week", "key"],
                      names=("current", "older"))


def benefit_cat(df: DataFrame, p: Params) -> DataFrame:
    """P05."""
    return _benefit(df, p, "cat")


def benefit_total(df: DataFrame, p: Params) -> DataFrame:
    """P06 as intended: one overall row, of zeros where there are no attempts."""
    one = _benefit(df, p, "total").agg(F.count(F.lit(1)).alias("n"), *[
        F.max(c).alias(c) for c in ("records", "attempts", "contacts", "sales")])
    none = F.col("n") == 0
    return benefit_ratios(one.select(*[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
                                       for c in ("records", "attempts", "contacts", "sales")]))


def benefit_case(df: DataFrame, p: Params) -> DataFrame:
    """P06 as written: the table is still grouped by case, so one row per case."""
    return benefit(df, ["id"])


def benefit_segs_week_long(df: DataFrame, p: Params) -> DataFrame:
    """T; per segment, week and period; the four ratios long as metric/value."""
    return to_long(_benefit(df, p, "t_segs_week"), BENEFIT_RATIOS, "metric", "value")


def benefit_cat_week_long(df: DataFrame, p: Params) -> DataFrame:
    """P08."""
    return to_long(_benefit(df, p, "t_cat_week"), BENEFIT_RATIOS, "metric", "value")


def benefit_week_long(df: DataFrame, p: Params) -> DataFrame:
    """Positions 7:9 of the original take three ratios; conversion stays a column."""
    return to_long(_benefit(df, p, "t_week"), ["sales_to_dials", "sales_to_connects", "avg_dials"],
                   "metric", "value")


# -- daily counts ------------------------------------------------------------------------
# P10-P13 are sums over one table of the period's attempt counts per day, segment,
# contact, sale and group (row counts add up exactly), so those attempts are read
# once, and on the stored table only the period's date partitions.

_DAY_KEYS = ["placed_date", "segs", "is_contact", "is_sale", "pilot_cat"]


def _daily(df: DataFrame, p: Params) -> DataFrame:
    return _shared(df, p, "daily_counts", lambda: count_rows(_tweak(df, p), _DAY_KEYS, "n"))


def _sum_counts(base: DataFrame, keys, name: str) -> DataFrame:
    return base.groupBy(*keys).agg(F.sum("n").alias(name))


def dials_by_date(df: DataFrame, p: Params) -> DataFrame:
    """P10."""
    return _sum_counts(_daily(df, p), ["placed_date"], "attempts")


def dials_by_date_segs(df: DataFrame, p: Params) -> DataFrame:
    """P11."""
    return _sum_counts(_daily(df, p), ["placed_date", "segs"], "attempts")


def dials_by_contact(df: DataFrame, p: Params) -> DataFrame:
    """P12."""
    return _sum_counts(_daily(df, p), ["placed_date", "segs", "is_contact"], "attempts")


def contacts_by_sale(df: DataFrame, p: Params) -> DataFrame:
    """Contacts only."""
    sel = _daily(df, p).where(F.col("is_contact") == 1)
    return _sum_counts(sel, ["placed_date", "segs", "is_sale", "pilot_cat"], "attempts")


def sales_by_pilot(df: DataFrame, p: Params) -> DataFrame:
    """Sales in both periods."""
    sel = df.where(F.col("is_sale") == 1)
    return count_rows(sel, ["placed_date", "segs", "pilot_cat", "dialer_tweak"], "sales")


# -- hour of day ---------------------------------------------------------------------------

def hour_rates(df: DataFrame, p: Params) -> DataFrame:
    """Per hour; share of all attempts and the two rates, unrounded.

    The grand total is a window without keys over the per-hour rows: at most 25
    (hours 0-23 and missing), so one pass over the attempts suffices.
    """
    def build():
        agg = contact_sale_rates(_tweak(df, p), ["placed_hour"], digits=None)
        agg = with_share(agg, "attempts", [], "attempt_perc", digits=None, grand="window")
        return agg.select("placed_hour", "attempts", "contacts", "sales",
                          "attempt_perc", "contact_perc", "sales_perc")
    return _shared(df, p, "hour_rates", build)


def hour_rates_long(df: DataFrame, p: Params) -> DataFrame:
    """P16 long over the three rates."""
    return to_long(hour_rates(df, p), ["attempt_perc", "contact_perc", "sales_perc"], "key", "value")


# -- single cases --------------------------------------------------------------------------

def _history(df: DataFrame, ids, missing: str) -> DataFrame:
    """The chosen cases' attempts (None: all cases'), picked before they are numbered and sorted."""
    chosen = df if ids is None else df.where(F.col("id").isin(*ids))
    out = number_attempts(chosen.drop("attempt_no"), "id", "placed_time", missing=missing).select(*df.columns)
    return out.orderBy("id", *time_order(out))


def case_history(df: DataFrame, p: Params) -> DataFrame:
    """Attempts of one case in time order, numbered 1..n (attempts without a
    time numbered last)."""
    return _history(df, p.case_id, "last")


def case_history_shared(df: DataFrame, p: Params) -> DataFrame:
    """As P17 for another case."""
    return _history(df, p.shared_case_id, "last")


def cases_history(df: DataFrame, p: Params) -> DataFrame:
    """Several cases with the number recomputed (null time -> no number)."""
    return _history(df, p.case_ids, "null")


# -- attempt order -------------------------------------------------------------------------

def _first(df: DataFrame, p: Params, cap: int) -> DataFrame:
    """Attempts numbered below ``cap`` (numbered over the whole case history)."""
    if p.renumber_first_attempts:
        return first_attempts(df, cap)
    return df.where(F.col("attempt_no") < cap)


def _first_attempts(df: DataFrame, p: Params, cap: int) -> DataFrame:
    return _tweak(_first(df, p, cap), p)


def _by_attempt(df: DataFrame, p: Params) -> DataFrame:
    """P20-P22 share one aggregate of the first attempts per attempt number and segment."""
    def build():
        sel = _first_attempts(df, p, p.attempt_cap)
        return sel.groupBy("attempt_no", "segs").agg(
            S.r_n_distinct("id").alias("number"),
            F.count(F.lit(1)).alias("attempts"),
            S.r_sum("is_contact").alias("contacts"),
            S.r_sum("is_sale").alias("sales"))
    return _shared(df, p, "by_attempt", build)


def attempt_dist(df: DataFrame, p: Params) -> DataFrame:
    """P20: distinct cases per attempt number and segment."""
    return _by_attempt(df, p).select("attempt_no", "segs", "number")


def attempt_rates_long(df: DataFrame, p: Params) -> DataFrame:
    """Contact and sale rates (shares, 2 decimals), long over the rates."""
    agg = with_rates(_by_attempt(df, p).drop("number"))
    return to_long(agg, ["contact_perc", "sales_perc"], "key", "value")


def attempt_counts_long(df: DataFrame, p: Params) -> DataFrame:
    """Rates as percents; long over contacts and sales."""
    agg = with_rates(_by_attempt(df, p).drop("number"), scale=100.0)
    return to_long(agg, ["contacts", "sales"], "key", "value")


# -- finish codes --------------------------------------------------------------------------

def _result_counts(df: DataFrame, p: Params) -> DataFrame:
    """P23/P24 share the period's row counts per segment, category and contact flag."""
    return _shared(df, p, "result_counts",
                   lambda: count_rows(_tweak(df, p), ["segs", "result_cat", "is_contact"]))


def _result_dist(df: DataFrame, p: Params, contact: int, min_perc) -> DataFrame:
    rows = (_result_counts(df, p).where(F.col("is_contact") == contact)
            .select("segs", "result_cat", "rows"))
    out = with_share(rows, "rows", ["segs"], "perc")
    if min_perc is not None:
        out = out.where(F.col("perc") > min_perc)
    return (category_order(out, "result_cat", "perc")
            .orderBy(F.col("segs").asc_nulls_last(), F.col("rows").desc(),
                     F.col("result_cat").asc_nulls_last()))


def result_dist_noncontact(df: DataFrame, p: Params) -> DataFrame:
    """Finish-code categories of non-contacts, share per segment."""
    return _result_dist(df, p, 0, None)


def result_dist_contact(df: DataFrame, p: Params) -> DataFrame:
    """The same for contacts, small shares left out."""
    return _result_dist(df, p, 1, p.contact_share_min)


def finish_codes(df: DataFrame, p: Params) -> DataFrame:
    """P25: rows per cleaned finish code, most first."""
    return (count_rows(df, ["result2"])
            .orderBy(F.col("rows").desc(), F.col("result2").asc_nulls_last()))


def attempt_sequences(df: DataFrame, p: Params) -> DataFrame:
    """The first attempts' categories of each case as one text; frequency of
    each text per segment, kept when its rounded share reaches the threshold."""
    n = p.sequence_cap - 1
    names = [ORDINALS[i] if i < len(ORDINALS) else f"attempt_{i + 1}" for i in range(n)]
    sel = (_first(df, p, p.sequence_cap).where(F.col("segs") == p.sequence_segment)
           .select("segs", "id", "result_cat", "attempt_no"))
    categories = sorted(set(CODE_CATEGORY.values()))  # every value result_cat can take
    wide = to_wide_coded(sel, "attempt_no", "result_cat", list(range(1, n + 1)), names, categories)
    seq = (wide.withColumn("sequence", sequence_text(names))
           .groupBy("segs", "sequence").agg(F.count(F.lit(1)).alias("freq")))
    return (with_share(seq, "freq", ["segs"], "freq_perc")
            .where(F.col("freq_perc") >= p.sequence_share_min)
            .orderBy(F.col("segs").asc_nulls_last(), F.col("freq").desc(), F.col("sequence")))


# -- customer attribute ---------------------------------------------------------------------

def _profile(df: DataFrame, p: Params) -> DataFrame:
    """P27, P28 and P40 are sums over one table of row counts per segment,
    birth-date flag, customer attribute, contact and sale (all rows, no period
    filter): one read of the attempts for the three."""
    keys = ["segs", "no_birth", "customer_att", "is_contact", "is_sale"]
    flagged = df if "no_birth" in df.columns else df.withColumn("no_birth", D.birth_missing("date_of_birth"))
    return _shared(df, p, "profile_counts", lambda: count_rows(flagged, keys, "n"))


def att_contact(df: DataFrame, p: Params) -> DataFrame:
    """Contact split per customer attribute, 3 decimals."""
    rows = _sum_counts(_profile(df, p), ["customer_att", "is_contact"], "rows")
    return with_share(rows, "rows", ["customer_att"], "contact_perc", digits=3)


def att_sale(df: DataFrame, p: Params) -> DataFrame:
    """P28."""
    rows = _sum_counts(_profile(df, p), ["customer_att", "is_sale"], "rows")
    return with_share(rows, "rows", ["customer_att"], "sale_perc", digits=3)


# -- talk time (A07) ------------------------------------------------------------------------

def sales_per_week(df: DataFrame, p: Params) -> DataFrame:
    """T; talk hours, sales and sales per hour per segment and week (as text)."""
    def build():
        sel = _tweak(df.withColumn("placed_week", F.col("placed_week").cast("string")), p)
        return talk_time(sel, ["segs", "placed_week"])
    return _shared(df, p, "sales_per_week", build)


def _by_week(df: DataFrame, p: Params, value: str) -> DataFrame:
    return to_wide(sales_per_week(df, p).select("segs", "placed_week", value),
                   "placed_week", value, _text_columns(p.week_columns))


def sales_hour_by_week(df: DataFrame, p: Params) -> DataFrame:
    """P30."""
    return _by_week(df, p, "sales_hour")


def sales_by_week(df: DataFrame, p: Params) -> DataFrame:
    """P31."""
    return _by_week(df, p, "sales")


def hours_by_week(df: DataFrame, p: Params) -> DataFrame:
    """P32."""
    return _by_week(df, p, "hours")


def sales_hours_long(df: DataFrame, p: Params) -> DataFrame:
    """Hours and sales long."""
    return to_long(sales_per_week(df, p).drop("sales_hour"), ["hours", "sales"], "key", "value")


def sales_hour_line(df: DataFrame, p: Params) -> DataFrame:
    """P34."""
    return sales_per_week(df, p).select("segs", "placed_week", "sales_hour")


def sales_per_hour(df: DataFrame, p: Params) -> DataFrame:
    """As P29 per hour of the day (as text)."""
    def build():
        sel = _tweak(df.withColumn("placed_hour", F.col("placed_hour").cast("string")), p)
        return talk_time(sel, ["segs", "placed_hour"])
    return _shared(df, p, "sales_per_hour", build)


def _by_hour(df: DataFrame, p: Params, value: str) -> DataFrame:
    return to_wide(sales_per_hour(df, p).select("segs", "placed_hour", value),
                   "placed_hour", value, _text_columns(p.hour_columns))


def sales_hour_by_hour(df: DataFrame, p: Params) -> DataFrame:
    """P36."""
    return _by_hour(df, p, "sales_hour")


def sales_by_hour(df: DataFrame, p: Params) -> DataFrame:
    """P37."""
    return _by_hour(df, p, "sales")


def hours_by_hour(df: DataFrame, p: Params) -> DataFrame:
    """P38."""
    return _by_hour(df, p, "hours")


def sales_hour_by_hour_line(df: DataFrame, p: Params) -> DataFrame:
    """Some hours left out (compared as text; a missing hour is dropped too)."""
    return (sales_per_hour(df, p).select("segs", "placed_hour", "sales_hour")
            .where(~F.col("placed_hour").isin(*p.hours_left_out)))


# -- birth date, uncategorised ---------------------------------------------------------------

def _birth_share(rows: DataFrame) -> DataFrame:
    return with_share(rows, "rows", ["segs"], "no_birth_perc")


def birth_missing(df: DataFrame, p: Params) -> DataFrame:
    """Share of attempts without a birth date, per segment."""
    return _birth_share(_sum_counts(_profile(df, p), ["segs", "no_birth"], "rows"))


def birth_missing_cases(df: DataFrame, p: Params) -> DataFrame:
    """The same over first attempts, i.e. per case."""
    first = _first(df, p, 2).withColumn("no_birth", D.birth_missing("date_of_birth"))
    return _birth_share(count_rows(first, ["segs", "no_birth"]))


def uncategorised(df: DataFrame, p: Params) -> DataFrame:
    """Attempts whose finish code has no category."""
    return df.where(F.col("result_cat").isNull())


# -- talk time per finish-code category --------------------------------------------------------

def talk_time_by_result(df: DataFrame, p: Params) -> DataFrame:
    """T and week below the cap, both as text; hours (``length``), sales,
    sales per hour per segment, category and week."""
    def build():
        sel = _tweak(df.withColumn("placed_week", F.col("placed_week").cast("string")), p)
        sel = sel.where(F.col("placed_week") < F.lit(p.week_cap_text))
        return talk_time(sel, ["segs", "result_cat", "placed_week"], hours="length")
    return _shared(df, p, "talk_time_by_result", build)


def talk_time_by_result_wide(df: DataFrame, p: Params) -> DataFrame:
    """Wide on hours; sales and sales per hour stay row keys."""
    return to_wide(talk_time_by_result(df, p), "placed_week", "length", _text_columns(p.week_columns))


def talk_time_share_wide(df: DataFrame, p: Params) -> DataFrame:
    """Percent of hours within segment and week, wide by week."""
    t = with_exact_share_of_rounded(talk_time_by_result(df, p), "length", ["segs", "placed_week"],
                                    "length_perc", digits=2, scale=100.0)
    return to_wide(t.drop("length"), "placed_week", "length_perc", _text_columns(p.week_columns))


def talk_time_share(df: DataFrame, p: Params) -> DataFrame:
    """Categorised rows; share of hours within segment and week (2 decimals)
    and ``bar_share``, the drawn share rescaled to 1 per segment and week."""
    t = talk_time_by_result(df, p).where(F.col("result_cat").isNotNull())
    t = with_exact_share_of_rounded(t, "length", ["segs", "placed_week"], "length_perc", digits=2)
    t = with_exact_share_of_rounded(t, "length_perc", ["segs", "placed_week"], "bar_share", digits=None)
    return t.drop("length", "sales_hour")


# -- months ------------------------------------------------------------------------------------

def month_compare(df: DataFrame, p: Params) -> DataFrame:
    """Per month; distinct customers, attempts, contacts, sales.

    Fixed values: the original's names of the last two columns.
    """
    sel = df.where(F.col("placed_month").isin(*p.months))
    return sel.groupBy("placed_month").agg(
        S.r_n_distinct("customer").alias("records"),
        rows_in(sel).alias("attempts"),
        total(sel, "is_contact").alias("effectieven"),
        total(sel, "is_sale").alias("positieven"),
    )
