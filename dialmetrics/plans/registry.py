"""Report registry: name -> function, and the attempts table behind them."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import derive_attempts
from ..operators.losses import loss_report
from ..params import FIXTURE, Params
from ..session import ensure_checkpoint_dir
from ..sources.dictionary import DESCRIPTIONS, VALUE_COLUMNS, data_dictionary, dictionary_values
from ..sources.fixture import raw_extract
from ..sources.growing import append_load, create_store, read_grown
from . import reports as R

# name -> (report, reads the derived attempt_no, extract): "current", "older" (P04) or "both".
# First-k reports number their own first attempts (``first_attempts``), so they
# do not need the full numbering of the attempts table.
REPORTS: dict[str, tuple[Callable, bool, str]] = {
    "attempts": (R.attempts, True, "current"),
    "extremes": (R.extremes, False, "current"),
    "benefit_segs": (R.benefit_segs, False, "current"),
    "benefit_segs_weeks": (R.benefit_segs_weeks, False, "current"),
    "benefit_segs_weeks_v1": (R.benefit_segs_weeks, False, "older"),
    "benefit_segs_weeks_diff": (R.benefit_segs_weeks_diff, False, "both"),
    "benefit_cat": (R.benefit_cat, False, "current"),
    "benefit_total": (R.benefit_total, False, "current"),
    "benefit_case": (R.benefit_case, False, "current"),
    "benefit_segs_week_long": (R.benefit_segs_week_long, False, "current"),
    "benefit_cat_week_long": (R.benefit_cat_week_long, False, "current"),
    "benefit_week_long": (R.benefit_week_long, False, "current"),
    "dials_by_date": (R.dials_by_date, False, "current"),
    "dials_by_date_segs": (R.dials_by_date_segs, False, "current"),
    "dials_by_contact": (R.dials_by_contact, False, "current"),
    "contacts_by_sale": (R.contacts_by_sale, False, "current"),
    "sales_by_pilot": (R.sales_by_pilot, False, "current"),
    "hour_rates_long": (R.hour_rates_long, False, "current"),
    "hour_rates": (R.hour_rates, False, "current"),
    "case_history": (R.case_history, False, "current"),
    "case_history_shared": (R.case_history_shared, False, "current"),
    "cases_history": (R.cases_history, False, "current"),
    "attempt_dist": (R.attempt_dist, False, "current"),
    "attempt_rates_long": (R.attempt_rates_long, False, "current"),
    "attempt_counts_long": (R.attempt_counts_long, False, "current"),
    "result_dist_noncontact": (R.result_dist_noncontact, False, "current"),
    "result_dist_contact": (R.result_dist_contact, False, "current"),
    "finish_codes": (R.finish_codes, False, "current"),
    "attempt_sequences": (R.attempt_sequences, False, "current"),
    "att_contact": (R.att_contact, False, "current"),
    "att_sale": (R.att_sale, False, "current"),
    "sales_per_week": (R.sales_per_week, False, "current"),
    "sales_hour_by_week": (R.sales_hour_by_week, False, "current"),
    "sales_by_week": (R.sales_by_week, False, "current"),
    "hours_by_week": (R.hours_by_week, False, "current"),
    "sales_hours_long": (R.sales_hours_long, False, "current"),
    "sales_hour_line": (R.sales_hour_line, False, "current"),
    "sales_per_hour": (R.sales_per_hour, False, "current"),
    "sales_hour_by_hour": (R.sales_hour_by_hour, False, "current"),
    "sales_by_hour": (R.sales_by_hour, False, "current"),
    "hours_by_hour": (R.hours_by_hour, False, "current"),
    "sales_hour_by_hour_line": (R.sales_hour_by_hour_line, False, "current"),
    "birth_missing": (R.birth_missing, False, "current"),
    "birth_missing_cases": (R.birth_missing_cases, False, "current"),
    "uncategorised": (R.uncategorised, True, "current"),
    "talk_time_by_result": (R.talk_time_by_result, False, "current"),
    "talk_time_by_result_wide": (R.talk_time_by_result_wide, False, "current"),
    "talk_time_share_wide": (R.talk_time_share_wide, False, "current"),
    "talk_time_share": (R.talk_time_share, False, "current"),
    "month_compare": (R.month_compare, False, "current"),
}


# Built attempts plans per session: a DataFrame is an immutable, lazy plan, so the
# same object can feed every report; each report still reads the tables when it
# runs. Building the plan (analysis over py4j) costs more than running a report
# on small inputs. Assumes the input tables do not change during the session;
# ``clear_plan_cache()`` forgets the plans.
_PLANS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def clear_plan_cache() -> None:
    """Forget the built attempts plans and unpersist the shared report aggregates."""
    R.clear_shared()
    _PLANS.clear()


def load_attempts(spark: SparkSession, sf_dir: str, params: Params = FIXTURE,
                  extract: str = "current", numbered: bool = True) -> DataFrame:
    """The attempts table of the test tables; ``extract="older"`` is the second
    extract (customers with a non-negative balance, no talk time)."""
    per_session = _PLANS.setdefault(spark, {})
    key = (sf_dir, params, extract, numbered)
    if key not in per_session:
        if extract == "older":
            raw = raw_extract(spark, sf_dir, min_acctbal=0, with_length=False)
        else:
            raw = raw_extract(spark, sf_dir)
        per_session[key] = derive_attempts(raw, params, numbered=numbered)
    return per_session[key]


def run_report(name: str, spark: SparkSession, sf_dir: str, params: Params = FIXTURE) -> DataFrame:
    fn, numbered, extract = REPORTS[name]
    if extract == "both":
        return fn(*[load_attempts(spark, sf_dir, params, x, numbered) for x in ("current", "older")], params)
    return fn(load_attempts(spark, sf_dir, params, extract, numbered), params)


def queries(params: Params = FIXTURE) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name):
        return lambda spark, sf_dir: run_report(name, spark, sf_dir, params)
    def dictionary(spark, sf_dir):
        raw = raw_extract(spark, sf_dir).select(*DESCRIPTIONS)
        return data_dictionary(raw, DESCRIPTIONS, {c: 1 for c in VALUE_COLUMNS}).drop("data_type")

    def values(spark, sf_dir):
        return dictionary_values(raw_extract(spark, sf_dir), VALUE_COLUMNS)

    def from_loads(spark, sf_dir):
        """The attempts of a store that grew by three loads, the last one of late attempts and untimed ones."""
        raw = raw_extract(spark, sf_dir)
        path = f"{ensure_checkpoint_dir(spark)}/grown-{uuid.uuid4().hex}"
        create_store(spark, path, params)
        late = (F.col("event_id") % 10 == 3) | F.col("CALLPLACEDTIME").isNull()
        first = F.substring("CALLPLACEDTIME", 1, 10) < F.lit(params.cut)
        for name, load in (("before", ~late & first), ("since", ~late & ~first), ("late", late)):
            append_load(raw.where(load), path, params, name)
        return read_grown(spark, path, params)

    def parse_losses(spark, sf_dir):
        return loss_report(raw_extract(spark, sf_dir))

    return {name: make(name) for name in REPORTS} | {"attempts_from_loads": from_loads, "parse_losses": parse_losses} | {"data_dictionary": dictionary, "dictionary_values": values}
