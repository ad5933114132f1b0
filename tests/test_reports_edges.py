"""Reports on hand-made fixtures with expected rows, and properties."""

import math

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from dialmetrics.functions import semantics as S
from dialmetrics.operators.metrics import benefit
from dialmetrics.params import FIXTURE
from dialmetrics.plans import reports as R
from dialmetrics.plans.registry import clear_plan_cache, queries


def test_edge_sequence(spark):
    rows = [("Z", 1, "Busy", 1), ("Z", 1, None, 2), ("Z", 1, "Effective", 3)]          # null in the middle
    rows += [("Z", 2, "Busy", 1), ("Z", 2, None, 2), ("Z", 2, "Effective", 3)]         # same text
    rows += [("Z", 3, "No answer", i) for i in range(1, 13)]                          # more than 10
    rows += [("Z", 4, "Busy", None), ("A", 5, "Busy", 1)]                              # no number; other segment
    df = spark.createDataFrame(rows, "segs string, id long, result_cat string, attempt_no int")
    numbered = FIXTURE.with_(renumber_first_attempts=False, sequence_cap=11)  # attempt_no given, as in a stored table
    got = {(r.sequence, r.freq, r.freq_perc) for r in R.attempt_sequences(df, numbered).collect()}
    assert got == {
        ("Busy, NA, Effective, NA, NA, NA, NA, NA, NA, NA", 2, 0.67),
        (", ".join(["No answer"] * 10), 1, 0.33),
    }


def test_benefit_zero_and_missing_divisors(spark):
    rows = [("A", 1, 0, 0), ("A", 2, 0, 0),           # no contacts: 0/0 sales per contact
            ("C", 3, 1, 1), ("C", 3, None, 0),        # a missing flag: contacts missing
            ("E", 4, 1, 1), ("E", 5, 1, 0), ("E", 6, 0, 0)]
    df = spark.createDataFrame(rows, "segs string, id long, is_contact int, is_sale int")
    out = {r.segs: r for r in benefit(df, ["segs"]).collect()}
    assert out["A"].contacts == 0 and math.isnan(out["A"].sales_to_connects) and out["A"].conversion == 0.0
    assert out["C"].contacts is None and out["C"].sales_to_connects is None and out["C"].records == 1
    assert out["E"].conversion == 33.33 and out["E"].sales_to_connects == 50.0 and out["E"].avg_dials == 1.0


def test_results_do_not_depend_on_partition_count(spark):
    names = ["benefit_segs_weeks", "attempt_sequences", "talk_time_share_wide", "result_dist_noncontact",
             "attempts"]
    res = {}
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        clear_plan_cache()
        res[parts] = {}
        for n in names:
            df = queries()[n](spark, SF001)
            res[parts][n] = canon([tuple(r) for r in df.collect()], df.columns)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    clear_plan_cache()
    assert res["1"] == res["13"]


def test_shares_sum_to_one_before_rounding(spark):
    df = queries()["result_dist_noncontact"](spark, SF001)
    tot = df.groupBy("segs").agg(F.sum("rows").alias("t"))
    chk = df.join(tot, "segs").groupBy("segs").agg(F.sum(F.col("rows") / F.col("t")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in chk)


def test_contacts_at_least_sales(spark):
    df = queries()["benefit_segs"](spark, SF001)
    assert df.where(F.col("contacts") < F.col("sales")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(1, 5000)), min_size=50, max_size=300))
def test_round_half_even_matches_duckdb(spark, pairs):
    pdf = spark.createDataFrame(pairs, "k long, n long")
    ours = [r.v for r in pdf.select(
        S.round_k(S.ratio("k", "n") * 100, 2).alias("v"), "k", "n").orderBy("k", "n").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, n BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    theirs = [r[0] for r in con.sql(
        "SELECT round_even((k::DOUBLE / n::DOUBLE) * 100 * 100, 0) / 100 FROM t ORDER BY k, n").fetchall()]
    assert ours == theirs


def test_v4_missing_sorts_last_both_ways(spark):
    df = spark.createDataFrame([("Busy",), (None,), (None,), ("Busy",), ("Voicemail",), (None,)], "result2 string")
    df = df.select("result2", F.lit("A").alias("segs"), F.lit("--").alias("date_of_birth"),
                   F.lit("ATT0").alias("customer_att"), F.lit(0).alias("is_contact"), F.lit(0).alias("is_sale"))
    assert [tuple(r) for r in R.finish_codes(df, FIXTURE).collect()] == [(None, 3), ("Busy", 2), ("Voicemail", 1)]
    ex = spark.createDataFrame([(s, i) for s, i, n in [(None, 1, 20), ("A", 2, 18), ("A", 3, 30)] for _ in range(n)],
                               "segs string, id long")
    assert [(r.segs, r.id) for r in R.extremes(ex, FIXTURE).collect()] == [("A", 3), ("A", 2), (None, 1)]


def test_v11_missing_key_is_a_group_and_v15_sums_are_bigint(spark):
    df = spark.createDataFrame([(None, 1, 1, 1), (None, 2, 0, 0), ("A", 3, 1, 0)],
                               "segs string, id long, is_contact int, is_sale int")
    out = {r.segs: r for r in benefit(df, ["segs"]).collect()}
    assert out[None].records == 2 and out[None].attempts == 2 and out[None].sales == 1
    types = dict(benefit(df, ["segs"]).dtypes)
    assert types["contacts"] == types["sales"] == types["records"] == types["attempts"] == "bigint"


def test_v13_wide_columns_in_text_order(spark):
    df = spark.createDataFrame([("A", w, float(w)) for w in (1, 2, 10)], "segs string, placed_week int, v double")
    out = R.to_wide(df.withColumn("placed_week", F.col("placed_week").cast("string")), "placed_week", "v",
                    R._text_columns([1, 2, 10]))
    assert out.columns == ["segs", "1", "10", "2"]
    assert tuple(out.first()) == ("A", 1.0, 10.0, 2.0)


def test_talk_time_zero_hours(spark):
    from dialmetrics.operators.metrics import talk_time

    df = spark.createDataFrame([("A", 10, 1), ("C", 0, 0), ("E", None, 1)], "segs string, length long, is_sale int")
    out = {r.segs: r for r in talk_time(df, ["segs"]).collect()}
    assert out["A"].hours == 0.0 and out["A"].sales_hour == math.inf      # 10 s rounds to 0.00 h
    assert out["C"].hours == 0.0 and math.isnan(out["C"].sales_hour)
    assert out["E"].hours is None and out["E"].sales_hour is None


def test_old_and_new_extract_reports_align(spark):
    """P03 against P04: same columns; the older extract covers a subset of customers."""
    from dialmetrics.plans.registry import load_attempts

    new, old = queries()["benefit_segs_weeks"](spark, SF001), queries()["benefit_segs_weeks_v1"](spark, SF001)
    assert new.columns == old.columns
    assert {(r.segs, r.key) for r in old.collect()} <= {(r.segs, r.key) for r in new.collect()}
    a_new = load_attempts(spark, SF001, FIXTURE, "current", numbered=False)
    a_old = load_attempts(spark, SF001, FIXTURE, "older", numbered=False)
    assert a_old.select("customer").distinct().join(a_new.select("customer").distinct(), "customer",
                                                    "left_anti").count() == 0
    assert a_old.where(F.col("length").isNotNull()).count() == 0


def _r_benefit(rows):
    """Plain-Python statement of the R benefit block, for the property test."""
    import numpy as np

    def rnd(x):
        return None if x is None else float(np.rint(x * 100) / 100)

    def div(n, d):
        if n is None or d is None:
            return None
        if d == 0:
            return math.nan if n == 0 else math.copysign(math.inf, n)
        return n / d

    def rsum(vals):
        return None if any(v is None for v in vals) else sum(vals)

    out = {}
    for segs in {r[0] for r in rows}:
        g = [r for r in rows if r[0] == segs]
        records, attempts = len({r[1] for r in g}), len(g)
        contacts, sales = rsum([r[2] for r in g]), rsum([r[3] for r in g])
        pct = lambda n, d: rnd(None if div(n, d) is None else div(n, d) * 100)
        out[segs] = (records, attempts, contacts, sales, pct(sales, records), pct(sales, attempts),
                     pct(sales, contacts), rnd(div(attempts, records)))
    return out


def _same_value(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "Z", None]), st.sampled_from([1, 2, 3, 4, None]),
                          st.sampled_from([0, 1, 1, None]), st.sampled_from([0, 0, 1, None])),
                min_size=1, max_size=40))
def test_benefit_matches_r_rules_with_missing_values(spark, rows):
    df = spark.createDataFrame(rows, "segs string, id long, is_contact int, is_sale int")
    got = {r.segs: (r.records, r.attempts, r.contacts, r.sales, r.conversion, r.sales_to_dials,
                    r.sales_to_connects, r.avg_dials) for r in benefit(df, ["segs"]).collect()}
    want = _r_benefit(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert all(_same_value(a, b) for a, b in zip(got[k], want[k])), (k, got[k], want[k])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "Z", None]), st.sampled_from([0, 5, 17, 18, 3600, 7200, None]),
                          st.sampled_from([0, 1, None])), min_size=1, max_size=30))
def test_talk_time_matches_r_rules_with_missing_values(spark, rows):
    import numpy as np

    from dialmetrics.operators.metrics import talk_time

    df = spark.createDataFrame(rows, "segs string, length long, is_sale int")
    got = {r.segs: (r.hours, r.sales, r.sales_hour) for r in talk_time(df, ["segs"]).collect()}
    for segs in {r[0] for r in rows}:
        g = [r for r in rows if r[0] == segs]
        secs = None if any(r[1] is None for r in g) else sum(r[1] for r in g)
        sales = None if any(r[2] is None for r in g) else sum(r[2] for r in g)
        hours = None if secs is None else float(np.rint(secs / 3600 * 100) / 100)
        if sales is None or hours is None:
            sph = None
        elif hours == 0:
            sph = math.nan if sales == 0 else math.inf
        else:
            sph = float(np.rint(sales / hours * 100) / 100)
        assert all(_same_value(a, b) for a, b in zip(got[segs], (hours, sales, sph))), (segs, got[segs])


def test_benefit_sets_equal_separate_aggregations(spark):
    from dialmetrics.operators.metrics import benefit_grain, benefit_sets

    rows = [("A", "trial", 1, 1, 0), ("A", "trial", 1, 0, 0), (None, "error", 2, 1, 1), ("Z", "control", 3, None, 0),
            ("Z", "control", None, 1, 1), (None, "error", 4, 0, 0)]
    df = spark.createDataFrame(rows, "segs string, pilot_cat string, id long, is_contact int, is_sale int")
    grains = [["segs"], ["pilot_cat"], [], ["segs", "pilot_cat"]]
    sets = benefit_sets(df, grains)
    for i, g in enumerate(grains):
        a, b = benefit_grain(sets, grains, i), benefit(df, g)
        assert a.columns == b.columns
        assert canon([tuple(r) for r in a.collect()], a.columns) == canon([tuple(r) for r in b.collect()], b.columns)


def _talk(spark, rows):
    return spark.createDataFrame(rows, "segs string, result_cat string, placed_week int, length long, is_sale int") \
        .withColumn("placed_date", F.lit("2024-01-15").cast("date"))


def test_shares_of_a_week_with_missing_talk_time_are_missing(spark):
    """V1: a total is missing when one of its values is, so the others have no share of it."""
    df = _talk(spark, [("A", "Busy", 3, None, 0), ("A", "Effective", 3, 7200, 1), ("A", "Effective", 4, 3600, 1),
                       ("A", "Busy", 4, 3600, 0)])
    got = {(r.result_cat, r.placed_week): r for r in R.talk_time_share(df, FIXTURE).collect()}
    assert got[("Effective", "3")].length_perc is None and got[("Effective", "3")].bar_share is None
    assert got[("Effective", "4")].length_perc == 0.5 and got[("Effective", "4")].bar_share == 0.5


def test_shares_of_a_week_without_talk_are_nan(spark):
    df = _talk(spark, [("E", "Busy", 4, 0, 0), ("E", "Effective", 4, 10, 1), ("E", "Busy", 3, 3600, 0)])
    got = {(r.result_cat, r.placed_week): r for r in R.talk_time_share(df, FIXTURE).collect()}
    assert math.isnan(got[("Busy", "4")].length_perc) and math.isnan(got[("Effective", "4")].bar_share)
    assert got[("Busy", "3")].bar_share == 1.0


def test_missing_category_stands_last_and_shifts_no_other(spark):
    from dialmetrics.operators.shares import category_order

    df = spark.createDataFrame([("Busy", 0.3), (None, 0.2), ("Effective", 0.1), (None, 0.1), ("Call back", 0.3)],
                               "result_cat string, perc double")
    got = {r.result_cat: r.cat_order for r in category_order(df, "result_cat", "perc").collect()}
    assert got == {"Effective": 1, "Busy": 2, "Call back": 3, None: 4}


def test_no_attempts_count_as_zero(spark):
    """R gives a row of zeros for an ungrouped summary of no rows."""
    df = spark.createDataFrame([], "segs string, id long, is_contact int, is_sale int")
    for out in (benefit(df, []), R.benefit_total(df, FIXTURE)):
        r = out.first()
        assert (r.records, r.attempts, r.contacts, r.sales) == (0, 0, 0, 0) and math.isnan(r.conversion)
    assert benefit(df, ["segs"]).count() == 0
