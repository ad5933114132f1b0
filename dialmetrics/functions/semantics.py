"""Column expressions that keep R / dplyr value semantics on Spark.

Every helper returns a ``Column`` built from built-in functions only, so it

V1  ``r_sum``        -- a group sum is missing when any input is missing
V2  ``r_n_distinct`` -- a missing value counts as one distinct value
V5  ``ratio``        -- x/0 gives +-Infinity, 0/0 gives NaN (ANSI mode would raise)
V6  ``round_k``      -- round half to even on ``x * 10^k``
V7  ``to_int``       -- text to integer, truncating, bad text to null
V8  ``parse_date`` / ``parse_timestamp`` -- failed parses give null, never an error
V10 ``paste_na``     -- missing pieces are written as the text ``NA``
V14 ``if_else_na``   -- a missing condition takes its own branch
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats accepted by the year-month-day parser, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
# Day-month-year formats (F03, birth dates; not applied by default).
DMY_FORMATS = ("dd-MM-yyyy", "dd/MM/yyyy", "ddMMyyyy")
# Year-month-day texts with a full clock time (a date alone is a failed parse, as
# in lubridate's ymd_hms): separated, with one- or two-digit parts, and compact.
_CLOCK = r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]+)?)"
SEPARATED_TIME = r"^\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})[ T]+" + _CLOCK + r"\s*$"
COMPACT_TIME = r"^\s*([0-9]{4})([0-9]{2})([0-9]{2})[ T]*([0-9]{2}):?([0-9]{2}):?([0-9]{2}(?:\.[0-9]+)?)\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r_sum(x, na_rm: bool = False) -> Column:
    """Group sum; missing as soon as one value is missing unless ``na_rm``; 0 over no rows."""
    x = _c(x)
    if na_rm:
        return F.sum(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def r_n_distinct(x) -> Column:
    """Exact distinct count where null is one more value."""
    x = _c(x)
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def ratio(n, d, zero: str = "inf") -> Column:
    """``n / d`` as a double.

    ``zero="inf"``: division by zero gives +Infinity, -Infinity or NaN as in R.
    ``zero="null"``: division by zero gives null.
    A missing operand gives null.
    """
    n = _c(n).cast("double")
    d = _c(d).cast("double")
    if zero == "null":
        on_zero = F.lit(None).cast("double")
    else:
        on_zero = (F.when(F.isnan(n) | (n == 0), F.lit(float("nan")))
                   .when(n > 0, F.lit(float("inf")))
                   .otherwise(F.lit(float("-inf"))))
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .otherwise(on_zero))


def round_k(x, k: int = 2) -> Column:
    """Round half to even at ``k`` decimals: ``rint(x * 10^k) / 10^k``."""
    scale = float(10 ** k)
    return F.rint(_c(x).cast("double") * scale) / scale


def to_int(x) -> Column:
    """R ``as.integer`` on text: ``"1.7"`` -> 1, ``"x"`` -> null."""
    return _c(x).try_cast("double").try_cast("int")


def parse_date(x, formats=DATE_FORMATS) -> Column:
    """Year-month-day text to date; unparseable text gives null."""
    x = _c(x)
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])


def parse_dmy(x) -> Column:
    """Day-month-year text to date (lubridate ``dmy``); ``--`` and bad text give null."""
    return parse_date(x, DMY_FORMATS)


def parse_timestamp(x) -> Column:
    """Year-month-day and clock text (``2018-03-12 09:05:00``, ``2018/3/12 9:05:00``,
    ``20180312 090500``) to a zone-free timestamp; bad text gives null.

    ``timestamp_ntz`` keeps the wall-clock value as written, so calendar fields
    do not depend on the session time zone of whatever cluster runs the job.
    """
    x = _c(x)
    parts = r"$1-$2-$3 $4:$5:$6"
    return (F.when(x.rlike(SEPARATED_TIME), F.regexp_replace(x, SEPARATED_TIME, parts))
            .when(x.rlike(COMPACT_TIME), F.regexp_replace(x, COMPACT_TIME, parts))
            .try_cast("timestamp_ntz"))


def ntz_text(x, length: int = 19) -> Column:
    """A zone-free timestamp as ``yyyy-MM-dd HH:mm:ss`` text (seconds truncated).

    ``date_format`` would first cast to a session-zone timestamp, which moves
    wall-clock times that fall in a daylight-saving gap; the string cast does not.
    """
    return F.substring(_c(x).cast("string"), 1, length)


def clock_text(x) -> Column:
    """``HH:mm:ss`` of a zone-free timestamp, without any time-zone conversion."""
    return F.substring(_c(x).cast("string"), 12, 8)


def r_week(d) -> Column:
    """lubridate ``week()``: complete 7-day blocks since 1 January, plus one.

    Not ISO week: 2017-01-01 is week 1 here and week 52 in ISO.
    """
    return (F.floor((F.dayofyear(_c(d)) - 1) / 7) + 1).cast("int")


def if_else_na(cond: Column, yes, no, missing) -> Column:
    """dplyr ``if_else(cond, yes, no, missing)``: null condition -> ``missing``."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond.isNull(), lit(missing)).when(cond, lit(yes)).otherwise(lit(no))


def paste_na(cols, sep: str = ", ") -> Column:
    """R ``paste(..., sep=sep)``: null pieces become the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c), F.lit("NA")) for c in cols])


def lookup(mapping: dict, x) -> Column:
    """Exact-text lookup in a fixed dictionary; no match or null gives null.

    The map literal is constant-folded, so this is a per-row probe inside
    codegen: no join, no shuffle.
    """
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(x))
