"""Every registered report against its DuckDB oracle (the driver's check), sf0.01."""

import pytest

import __spark_entry__ as E
from compare import compare_one, duck
from conftest import SF01
from dialmetrics.plans import oracle, registry

NAMES = list(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(registry.queries())
    assert set(oracle.oracle_sql()) <= set(E.oracle_sql()) and set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_report_matches_oracle(spark, con, name):
    ok, line = compare_one(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
    assert ok, line


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "segs" in df.columns


def test_reports_do_not_depend_on_session_settings(spark, con):
    """ANSI off, another session time zone and AQE off give the same results."""
    from dialmetrics.plans.registry import clear_plan_cache

    keys = ["spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        clear_plan_cache()
        for name in ["attempts", "benefit_segs", "hour_rates", "sales_per_hour", "talk_time_share",
                     "dials_by_date"]:
            ok, line = compare_one(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF01)
            assert ok, line
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        clear_plan_cache()
