import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dialmetrics.operators.reshape import to_long, to_wide


def test_long_keeps_nulls_and_wide_round_trips(spark):
    df = spark.createDataFrame([("A", 1, 2.0, None), ("C", 2, None, 0.5)], "segs string, w int, x double, y double")
    long = to_long(df, ["x", "y"], "key", "value")
    assert long.count() == 4 and long.where(F.col("value").isNull()).count() == 2
    back = to_wide(long, "key", "value", ["x", "y"])
    assert sorted(map(tuple, back.select("segs", "w", "x", "y").collect())) == sorted(map(tuple, df.collect()))


def test_wide_missing_cells_stay_null_and_names(spark):
    df = spark.createDataFrame([("A", 1, "p"), ("A", 3, "q")], "segs string, k int, v string")
    out = to_wide(df, "k", "v", [1, 2, 3], names=["first", "second", "third"]).collect()
    assert [tuple(r) for r in out] == [("A", "p", None, "q")]


def test_g03_two_rows_one_cell_raises(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.0)], "segs string, k int, v double")
    with pytest.raises(PySparkException, match="share one cell"):
        to_wide(df, "k", "v", [1]).collect()


def test_long_mixed_types_become_double(spark):
    df = spark.createDataFrame([("A", 1.5, 2)], "segs string, hours double, sales long")
    assert dict(to_long(df, ["hours", "sales"]).dtypes)["value"] == "double"


def test_wide_columns_from_the_data_like_spread(spark):
    from conftest import SF001
    from dialmetrics.params import FIXTURE
    from dialmetrics.plans import reports as R
    from dialmetrics.plans.registry import load_attempts

    df = load_attempts(spark, SF001, FIXTURE, numbered=False)
    free = FIXTURE.with_(week_columns=None, hour_columns=None)
    fixed_w, free_w = R.sales_by_week(df, FIXTURE), R.sales_by_week(df, free)
    weeks = [str(w) for w in range(2, 10)]
    assert set(free_w.columns) == {"segs", *weeks} - (set(weeks) - set(free_w.columns))
    assert "1" not in free_w.columns          # week 1 has no tweak rows
    assert sorted(map(tuple, free_w.collect())) == sorted(map(tuple, fixed_w.select(*free_w.columns).collect()))
    hours = R.hours_by_hour(df, free).columns[1:]
    assert hours == sorted(hours) and "10" in hours and hours.index("10") < hours.index("2")
    columns = R.benefit_segs_weeks(df, free).columns
    assert columns[:6] == ["segs", "key", "2", "3", "4", "5"] and columns[2:] == sorted(columns[2:], key=int)


def test_wide_fails_on_a_key_outside_the_list(spark):
    """No cell is lost unseen: a week that the list lacks fails the job; without a list it gets its column."""
    import pytest

    df = spark.createDataFrame([("A", 1, 1.0), ("A", 7, 2.0)], "segs string, k int, v double")
    with pytest.raises(Exception, match="k has a value outside the list: 7"):
        to_wide(df, "k", "v", [1, 2, 3]).collect()
    assert to_wide(df, "k", "v", None).columns == ["segs", "1", "7"]
    assert to_wide(df, "k", "v", [1, 2], others="drop").columns == ["segs", "1", "2"]


def test_wide_with_no_key_values(spark):
    df = spark.createDataFrame([("A", None, 1.0)], "segs string, k int, v double")
    out = to_wide(df, "k", "v", None)
    assert out.columns == ["segs"] and out.count() == 1


def test_reference_parameters_run_on_the_fixture(spark):
    """The original's own parameters: weeks above 5, months 2-4, whatever weeks the data has as columns."""
    from conftest import SF001
    from dialmetrics.params import REFERENCE
    from dialmetrics.plans import reports as R
    from dialmetrics.plans.registry import load_attempts

    df = load_attempts(spark, SF001, REFERENCE, numbered=False)
    assert all(int(w) > 5 for w in R.benefit_segs_weeks(df, REFERENCE).columns[2:])
    assert sorted(r.placed_month for r in R.month_compare(df, REFERENCE).collect()) == [2, 3]
    assert R.case_history(df, REFERENCE).count() == 0       # none of the original's cases
    assert R.sales_by_week(df, REFERENCE).count() > 0   # the cut is in 2018: all of 2024 is "tweak"


def test_coded_wide_equals_text_wide(spark):
    from dialmetrics.operators.reshape import to_wide_coded

    df = spark.createDataFrame([("Z", 1, 1, "Busy"), ("Z", 1, 2, None), ("Z", 1, 3, "Effective"), ("Z", 2, 1, "Voicemail")],
                               "segs string, id long, k int, v string")
    names = ["first", "second", "third", "fourth"]
    a = to_wide(df, "k", "v", [1, 2, 3, 4], names)
    b = to_wide_coded(df, "k", "v", [1, 2, 3, 4], names, ["Busy", "Effective", "Voicemail"])
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert "SortAggregate" not in b._jdf.queryExecution().executedPlan().toString()


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "C", None]), st.integers(1, 5),
                          st.one_of(st.none(), st.floats(-5, 5, allow_nan=False)),
                          st.one_of(st.none(), st.floats(-5, 5, allow_nan=False))),
                min_size=1, max_size=12, unique_by=lambda r: (r[0], r[1])))
def test_long_then_wide_gives_the_table_back(spark, rows):
    df = spark.createDataFrame(rows, "segs string, w int, x double, y double")
    back = to_wide(to_long(df, ["x", "y"], "key", "value"), "key", "value", ["x", "y"])
    assert sorted(map(tuple, back.select("segs", "w", "x", "y").collect()), key=str) == sorted(rows, key=str)


def test_wide_reports_fail_on_doubled_cells_without_another_job(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("A", 2, None)], "segs string, k int, v double")
    wide = to_wide(df, "k", "v", [1, 2])        # nothing runs yet
    assert wide._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
    with pytest.raises(PySparkException, match="share one cell of k = 2"):
        wide.collect()
    assert [tuple(r) for r in to_wide(df, "k", "v", [1, 2], check_unique=False).collect()] == [("A", 1.0, 2.0)]
    text = df.withColumn("v", df.v.cast("string"))
    with pytest.raises(PySparkException, match="share one cell"):
        to_wide(text, "k", "v", [1, 2]).collect()


def test_difference_of_two_tables(spark):
    from dialmetrics.operators.difference import difference

    nan = float("nan")
    a = spark.createDataFrame([("A", 1, 1.0), ("A", None, 2.0), (None, 1, None), ("C", 1, nan), ("E", 1, 5.0)], "s string, w int, value double")
    b = spark.createDataFrame([("A", 1, 3.0), ("A", None, 2.0), (None, 1, None), ("C", 1, nan), ("I", 1, 1.0)], a.schema)
    got = {(r.s, r.w): (r.new, r.old, r.delta, r.status) for r in difference(a, b, ["s", "w"], names=("new", "old")).collect()}
    assert got[("A", 1)] == (1.0, 3.0, -2.0, "changed") and got[("A", None)] == (2.0, 2.0, 0.0, "same")
    assert got[(None, 1)] == (None, None, None, "same") and got[("C", 1)][3] == "same"
    assert got[("E", 1)] == (5.0, None, None, "only new") and got[("I", 1)] == (None, 1.0, None, "only old")
    assert difference(a.limit(0), b.limit(0), ["s", "w"]).count() == 0
    with pytest.raises(PySparkException, match="key twice"):
        difference(a.unionByName(a.limit(1)), b, ["s", "w"]).collect()
