"""The typed ``attempts`` table from a raw extract.

All derivations are column expressions in two projections; then the attempt
number is joined on (numbering.py). The number is taken over *all* attempts of a
case, before any period filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import semantics as S
from ..params import Params
from .losses import LOST, lost_mask
from .numbering import TIE_COLUMNS, number_attempts

# Raw names -> report names.
RENAMES = {
    "CASE_ID_T": "id",
    "KLANTNR": "customer",
    "SEGMENT": "segs",
    "BATCH_TYPE": "batch",
    "CUSTOMER_ATT": "customer_att",
    "CURRENT_SUB": "sub",
    "SUB_START_DATE": "sub_start_date",
    "DATE_OF_BIRTH": "date_of_birth",
    "CALLPLACEDTIME": "placed_time",
    "CALLANSWEREDTIME": "answered_time",
    "LENGTH": "length",
    "ISCONTACT": "is_contact",
    "IS_SALE": "is_sale",
    "FINISHCODE": "result",
}

ATTEMPT_COLUMNS = [
    "id", "customer", "segs", "batch", "customer_att", "sub", "sub_start_date",
    "date_of_birth", "placed_time", "answered_time", "length", "is_contact", "is_sale",
    "result", "placed_date", "placed_week", "placed_month", "placed_moment", "placed_hour",
    "dialer_tweak", "pilot_cat", "result2", "result_cat", "attempt_no",
]


def period_flag(placed_date, cut: str):
    """Before the cut -> 'no tweak', from the cut on -> 'tweak', no date -> 'error'."""
    d = S._c(placed_date)
    return S.if_else_na(d < F.lit(cut).cast("date"), "no tweak", "tweak", "error")


def pilot_category(segs, control=("Z",)):
    """Control segments -> 'control', others -> 'trial', no segment -> 'error'."""
    return S.if_else_na(S._c(segs).isin(*control), "control", "trial", "error")


def birth_missing(date_of_birth):
    """1 when the birth date is the text '--', else 0 (also when missing)."""
    return S.if_else_na(S._c(date_of_birth) == F.lit("--"), 1, 0, 0)


def type_and_derive(raw: DataFrame, params: Params, losses: bool = False) -> DataFrame:
    """Rename, type and add the calendar, period, group and code columns; ``losses`` adds
    the mask of texts that did not parse (``losses.lost_mask``)."""
    if losses:
        raw = raw.withColumn(LOST, lost_mask())
    df = raw.withColumnsRenamed(RENAMES)
    df = df.withColumns({
        "sub_start_date": S.parse_date("sub_start_date"),
        "placed_time": S.parse_timestamp("placed_time"),
        "answered_time": S.parse_timestamp("answered_time"),
        "is_contact": S.to_int("is_contact"),
        "is_sale": S.to_int("is_sale"),
        "result2": codes.clean_code("result"),
    })
    df = df.withColumns({
        "placed_date": F.to_date("placed_time"),
        "placed_week": S.r_week(F.col("placed_time")),
        "placed_month": F.month("placed_time"),
        "placed_moment": S.clock_text("placed_time"),
        "placed_hour": F.hour("placed_time"),
        "pilot_cat": pilot_category("segs", params.control_segments),
        "result_cat": codes.code_category("result2"),
    })
    return df.withColumn("dialer_tweak", period_flag("placed_date", params.cut))


def derive_attempts(raw: DataFrame, params: Params, numbered: bool = True,
                    tie=TIE_COLUMNS, losses: bool = False) -> DataFrame:
    """The 24-column attempts table (plus tie-break columns present in ``raw``).

    ``numbered=False`` leaves the number out (null) for reports that do not read
    it or number their own first attempts: they then pay for no join or window.
    """
    df = type_and_derive(raw, params, losses)
    extra = [t for t in tie if t in df.columns] + [LOST] * losses
    if numbered:
        df = number_attempts(df, "id", "placed_time", tie=tie, out="attempt_no", missing="null")
    else:
        df = df.withColumn("attempt_no", F.lit(None).cast("int"))
    return df.select(*ATTEMPT_COLUMNS, *extra)
