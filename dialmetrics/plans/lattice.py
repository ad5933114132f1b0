"""Bases for the whole pack: the additive reports from four reads of the attempts.

Most reports count attempts, contacts, sales and talk time by a few keys, and such
counts add up. Run as a pack, they are taken from bases: the attempts counted once by
all the keys that a family of reports reads. A base is a table of attempts with
weights (``metrics.WEIGHT``), so the reports' own functions run on it unchanged.

* ``calendar``: by day, hour, segment, outcome; bounded by the keys' cardinalities
* ``profile``: by segment, birth-date flag, attribute, outcome; bounded likewise
* ``cases``: by case, segment, customer, month; as many rows as the case reports give
* the benefit family shares its key sets (``reports._benefit``): distinct cases add up
  through bitmaps, and come from the attempts themselves

A report takes the first base here that has every column it reads (``NEEDS``);
``cover`` says which, and raises where a column is in none. Reports of first attempts
and lists of attempts do not add up and read the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.derive import birth_missing
from ..operators.metrics import LENGTH, TIMED, WEIGHT

OUTCOME = ["is_contact", "is_sale"]
BASES: dict[str, list[str]] = {
    "profile": ["segs", "no_birth", "customer_att", *OUTCOME],
    "calendar": ["segs", "pilot_cat", "dialer_tweak", "placed_date", "placed_week", "placed_month", "placed_hour",
                 "result2", "result_cat", *OUTCOME],
    "cases": ["id", "segs", "customer", "placed_month", *OUTCOME],
}

# The columns that each additive report reads.
_DAY = ["placed_date", "segs", "pilot_cat", *OUTCOME]
_WEEK = ["placed_date", "placed_week", "segs", "is_sale"]
_HOUR = ["placed_date", "placed_hour", "segs", "is_sale"]
_RESULT = ["placed_date", "segs", "result_cat", "is_contact"]
_TALK = ["placed_date", "placed_week", "segs", "result_cat", "is_sale"]
NEEDS: dict[str, list[str]] = {
    **dict.fromkeys(["dials_by_date", "dials_by_date_segs", "dials_by_contact", "contacts_by_sale"], _DAY),
    "sales_by_pilot": [*_DAY, "dialer_tweak"],
    **dict.fromkeys(["hour_rates", "hour_rates_long"], ["placed_date", "placed_hour", *OUTCOME]),
    **dict.fromkeys(["result_dist_noncontact", "result_dist_contact"], _RESULT),
    "finish_codes": ["result2"],
    **dict.fromkeys(["att_contact", "att_sale", "birth_missing"], ["segs", "no_birth", "customer_att", *OUTCOME]),
    **dict.fromkeys(["sales_per_week", "sales_hour_by_week", "sales_by_week", "hours_by_week", "sales_hours_long",
                     "sales_hour_line"], _WEEK),
    **dict.fromkeys(["sales_per_hour", "sales_hour_by_hour", "sales_by_hour", "hours_by_hour",
                     "sales_hour_by_hour_line"], _HOUR),
    **dict.fromkeys(["talk_time_by_result", "talk_time_by_result_wide", "talk_time_share_wide", "talk_time_share"], _TALK),
    "extremes": ["segs", "id"],
    "benefit_case": ["id", *OUTCOME],
    "month_compare": ["placed_month", "customer", *OUTCOME],
}
BENEFIT = ["benefit_segs", "benefit_segs_weeks", "benefit_cat", "benefit_total", "benefit_segs_week_long",
           "benefit_cat_week_long", "benefit_week_long"]


def cover(names) -> dict[str, str]:
    """The base of each additive report among ``names``."""
    found = {}
    for name in names:
        if name in NEEDS:
            fitting = [b for b, keys in BASES.items() if set(NEEDS[name]) <= set(keys)]
            if not fitting:
                raise ValueError(f"no base has the columns of {name}: {NEEDS[name]}")
            found[name] = fitting[0]
    return found


def base(attempts: DataFrame, name: str) -> DataFrame:
    """The attempts by the keys of a base, with their number, talk time and number of known talk times."""
    if "no_birth" in BASES[name]:
        attempts = attempts.withColumn("no_birth", birth_missing("date_of_birth"))
    return attempts.groupBy(*BASES[name]).agg(
        F.count(F.lit(1)).alias(WEIGHT), F.coalesce(F.sum("length"), F.lit(0)).alias(LENGTH), F.count("length").alias(TIMED))


class Lattice:
    """The bases of one attempts table, each computed when its first report asks and kept until ``close``."""

    def __init__(self, attempts: DataFrame, names):
        self.attempts, self.plan, self.held = attempts, cover(names), {}

    def source(self, report: str) -> DataFrame:
        """What a report is computed from: its base, or the attempts."""
        name = self.plan.get(report)
        if name is None:
            return self.attempts
        if name not in self.held:
            self.held[name] = base(self.attempts, name).cache()
        return self.held[name]

    def close(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

    def __enter__(self) -> "Lattice":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
