"""Attempt numbering within a case (W01, W02): one plan for every size.

``row_number`` over ``Window.partitionBy(case)`` brings a whole case into one
task, and a case (or the rows without a case id) may hold a large share of all
rows. So attempts are numbered within (case, hour of the day they were placed):

1. attempts are counted per (case, hour), combined map-side;
2. a running sum over a case's hours says how many attempts came before an hour;
   a case has as many rows there as hours in which it was dialled;
3. each attempt's number is that sum plus its ``row_number`` within (case, hour).

Counts, join and window all use the keys (case, hour), so the attempts move once
and the hours of a hot case, customer or missing id spread over all tasks. What
is left in one task is one case in one hour. Nothing runs while the plan is
built, no size is tested and nothing is broadcast by hint.

Attempts without a time belong to no hour. In W01 they get no number; in W02
they come after the timed ones, by the tie-break. Where that is a whole number
(an event id), ranges of ``TIE_RANGE`` of it take the place of hours, so they
spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIE_RANGE = 65_536

# Order of attempts of one case placed in the same second: the tie-break column
# where the extract has one, else all that tells two attempts apart. Rows equal
# in all of these are interchangeable, so the numbers repeat from run to run.
TIE_COLUMNS = ("event_id",)
TIE_FALLBACK = ("answered_time", "length", "result", "is_contact", "is_sale", "customer", "segs",
                "batch", "customer_att", "sub", "sub_start_date", "date_of_birth")


def tie_columns(df: DataFrame, tie=TIE_COLUMNS) -> list[str]:
    """The tie-break columns that ``df`` has; without one, the fallback's."""
    found = [t for t in tie if t in df.columns]
    return found or [t for t in TIE_FALLBACK if t in df.columns]


def time_order(df: DataFrame, time: str = "placed_time", tie=TIE_COLUMNS) -> list[Column]:
    """By time (missing last), then by the tie-break."""
    return [F.col(c).asc_nulls_last() for c in [time, *tie_columns(df, tie)]]


def _stand_in(df: DataFrame, key: str) -> tuple[Column, Column]:
    """A key as two columns without nulls, so that plain equality joins missing keys too."""
    kind = df.schema[key].dataType
    zero = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("")
    value = F.col(key) if isinstance(kind, T.NumericType) else F.col(key).cast("string")
    return F.coalesce(value, zero), F.col(key).isNull()


SLOT_KEYS = ["_dm_case", "_dm_none", "_dm_late", "_dm_slot"]


def slot_columns(df: DataFrame, key: str = "id", time: str = "placed_time", tie=TIE_COLUMNS) -> list[Column]:
    """The (case, hour) of each row, as the columns ``SLOT_KEYS`` (none of them null)."""
    ties = tie_columns(df, tie)
    value, absent = _stand_in(df, key)
    hour = F.unix_date(F.to_date(time)).cast("long") * 24 + F.hour(time)
    whole = bool(ties) and isinstance(df.schema[ties[0]].dataType, T.IntegralType)
    untimed = F.floor(F.col(ties[0]) / TIE_RANGE) if whole else F.lit(0)
    return [value.alias("_dm_case"), absent.alias("_dm_none"), F.col(time).isNull().alias("_dm_late"),
            F.coalesce(hour, untimed.cast("long"), F.lit(2 ** 62)).alias("_dm_slot")]


def count_slots(df: DataFrame, key: str = "id", time: str = "placed_time", tie=TIE_COLUMNS) -> DataFrame:
    """``SLOT_KEYS`` and ``_dm_n``: attempts per (case, hour), combined map-side."""
    return df.select(*slot_columns(df, key, time, tie)).groupBy(*SLOT_KEYS).agg(F.count(F.lit(1)).alias("_dm_n"))


def with_before(counts: DataFrame, *clustered: str) -> DataFrame:
    """``counts`` plus ``_dm_before``: the attempts in the case's earlier hours. ``clustered``:
    functions of the case by which the rows are partitioned already."""
    before = (Window.partitionBy(*clustered, "_dm_case", "_dm_none").orderBy("_dm_late", "_dm_slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_dm_before", F.coalesce(F.sum("_dm_n").over(before), F.lit(0)))


def number_attempts(df: DataFrame, key: str = "id", time: str = "placed_time",
                    tie=TIE_COLUMNS, out: str = "attempt_no", missing: str = "null",
                    offsets: DataFrame | None = None) -> DataFrame:
    """Number rows within ``key`` by ``time`` (then ``tie``), starting at 1.

    ``missing="null"`` (W01, R ``row_number(x)``): rows without a time get no
    number and do not count. ``missing="last"`` (W02, ``1:n()`` after sorting):
    they are numbered after the timed rows, by the tie-break (the original leaves
    their order to that of the extract).

    ``offsets`` (``SLOT_KEYS`` and ``_dm_before`` of all timed rows) are stored
    ones, as a growing store keeps them; ``df`` is then read once. Their files are
    small for their rows (one for each (case, hour)), so a broadcast picked by file
    size would put a hash table of them all into every executor: they are merged.
    """
    if out in df.columns:
        df = df.drop(out)
    if offsets is not None and missing != "null":
        raise ValueError("stored offsets count timed attempts only")
    how = "inner" if offsets is None else "left"
    if offsets is None:
        offsets = with_before(count_slots(df, key, time, tie))
    else:
        offsets = offsets.hint("merge")
    order = [F.col(c).asc_nulls_last() for c in [time, *tie_columns(df, tie)]]
    number = (F.col("_dm_before") + F.row_number().over(Window.partitionBy(*SLOT_KEYS).orderBy(*order))).cast("int")
    if missing == "null":
        number = F.when(F.col(time).isNotNull(), number)
    return (df.select("*", *slot_columns(df, key, time, tie)).join(offsets.select(*SLOT_KEYS, "_dm_before"), SLOT_KEYS, how)
            .withColumn(out, number).select(*df.columns, out))


def first_attempts(df: DataFrame, cap: int, key: str = "id", time: str = "placed_time",
                   tie=TIE_COLUMNS, out: str = "attempt_no") -> DataFrame:
    """Attempts whose number (W01) is below ``cap``, numbered afresh.

    Only timed attempts are numbered (a missing time never counts, as in W01),
    with a plain ``row_number`` and a filter on it. That lets Catalyst insert
    ``WindowGroupLimit`` on both sides of the shuffle: every map task keeps at
    most ``cap - 1`` attempts per case before anything moves, so a long or hot
    case cannot skew the shuffle.
    """
    base = df.drop(out) if out in df.columns else df
    w = Window.partitionBy(key).orderBy(*time_order(base, time, tie))
    return (base.where(F.col(time).isNotNull())
            .withColumn(out, F.row_number().over(w))
            .where(F.col(out) < cap))
