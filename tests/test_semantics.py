
import datetime as dt
import math

from pyspark.sql import functions as F

from dialmetrics.functions import codes
from dialmetrics.functions import semantics as S
from dialmetrics.operators.derive import birth_missing, period_flag, pilot_category


def test_v1_sum_missing_when_any_missing(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", None), ("b", None), ("b", None), ("c", 1), ("c", 2)], "segs string, x int")
    got = {r.segs: (r.s, r.s_rm) for r in df.groupBy("segs").agg(
        S.r_sum("x").alias("s"), S.r_sum("x", na_rm=True).alias("s_rm")).collect()}
    assert got == {"a": (None, 1), "b": (None, None), "c": (3, 3)}


def test_v2_n_distinct_counts_null_once(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 2), ("b", 3), ("c", None)],
        "segs string, id long")
    got = {r.segs: r.n for r in df.groupBy("segs").agg(S.r_n_distinct("id").alias("n")).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}


def test_v5_ratio_zero_divisors(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (None, 0), (0, 3), (-2, 0)], "n int, d int")
    got = [r.r for r in df.select(S.ratio("n", "d").alias("r")).collect()]
    assert math.isnan(got[0]) and got[1] == math.inf and got[2] is None
    assert got[3] == 0.0 and got[4] == -math.inf
    nul = [r.r for r in df.select(S.ratio("n", "d", zero="null").alias("r")).collect()]
    assert nul[:3] == [None, None, None]


def test_v6_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5 / 100,), (float("nan"),), (float("inf"),), (None,)],
                               "x double")
    got = [r.r for r in df.select(S.round_k("x", 2).alias("r")).collect()]
    assert got[0] == 0.12 and got[1] == 0.38 and got[2] == 0.02
    assert math.isnan(got[3]) and got[4] == math.inf and got[5] is None
    assert [r.r for r in spark.createDataFrame([(0.0625,)], "x double")
            .select(S.round_k("x", 3).alias("r")).collect()] == [0.062]


def test_v7_v8_parsing_never_raises(spark):
    df = spark.createDataFrame(
        [("--",), ("",), ("1.7",), ("x",), (None,), ("1",), ("2024-01-03",), ("2024-01-03 10:11:12",)],
        "t string")
    rows = df.select(S.to_int("t").alias("i"), S.parse_date("t").alias("d"),
                     S.parse_timestamp("t").alias("ts")).collect()
    assert [r.i for r in rows] == [None, None, 1, None, None, 1, None, None]
    assert rows[6].d == dt.date(2024, 1, 3) and rows[0].d is None and rows[4].d is None
    assert rows[7].ts == dt.datetime(2024, 1, 3, 10, 11, 12)
    assert rows[6].ts is None  # a date without a clock time is not a timestamp


def test_v10_paste_writes_na(spark):
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert df.select(S.paste_na(["x", "y", "z"]).alias("s")).first().s == "a, NA, b"


def test_v14_flags_with_missing_inputs(spark):
    df = spark.createDataFrame(
        [(dt.date(2018, 3, 11), "Z", "--"), (dt.date(2018, 3, 12), "A", "01-01-1980"), (None, None, None)],
        "d date, segs string, dob string")
    rows = df.select(period_flag("d", "2018-03-12").alias("p"), pilot_category("segs").alias("c"),
                     birth_missing("dob").alias("b")).collect()
    assert [(r.p, r.c, r.b) for r in rows] == [
        ("no tweak", "control", 1), ("tweak", "trial", 0), ("error", "error", 0)]


def test_f06_week_is_not_iso(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2024, 1, 8), dt.date(2024, 12, 31),
            dt.date(2023, 12, 31), dt.date(2017, 1, 1), dt.date(2018, 3, 11), dt.date(2018, 3, 12)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.w for r in df.select(S.r_week("d").alias("w")).collect()]
    assert got == [1, 1, 2, 53, 53, 1, 10, 11]


def test_d03_d04_every_code_maps(spark):
    raw = list(codes.CLEAN_CODES) + [c for c in codes.CODE_CATEGORY if c not in codes.CLEAN_CODES.values()]
    rows = raw + ["Onbekend", None, "Busy (ISDN Cause Code 17)"]
    df = spark.createDataFrame([(r,) for r in rows], "result string")
    out = df.select("result", codes.clean_code("result").alias("r2")) \
            .withColumn("cat", codes.code_category("r2")).collect()
    by = {r.result: (r.r2, r.cat) for r in out}
    assert len(codes.CODE_CATEGORY) == 31 and len(codes.CLEAN_CODES) == 10
    for code in raw:
        assert by[code][1] is not None, code
    assert by["Normal, Specified (ISDN Cause Code 31)"] == ("Normal, Specified", "Technical")
    assert by["Onbekend"] == ("Onbekend", None)
    assert by["Busy (ISDN Cause Code 17)"] == ("Busy (ISDN Cause Code 17)", None)
    assert [r for r in out if r.result is None][0].r2 is None


def test_v12_week_compared_as_text(spark):
    df = spark.createDataFrame([(w,) for w in [1, 2, 3, 9, 10, 19, 20, 25]], "w int")
    got = [r.w for r in df.where(F.col("w").cast("string") < F.lit("20")).collect()]
    assert got == [1, 2, 10, 19]  # '2' is a prefix of '20', so smaller; '3'-'9' are larger


def test_f03_dmy_birth_dates(spark):
    df = spark.createDataFrame([("01-02-1980",), ("--",), ("31-02-1980",), (None,)], "t string")
    got = [r.d for r in df.select(S.parse_dmy("t").alias("d")).collect()]
    assert got == [dt.date(1980, 2, 1), None, None, None]


def test_wall_clock_kept_in_a_daylight_saving_gap(spark):
    """02:30 on 2018-03-25 does not exist in Amsterdam; zone-free times keep it."""
    from dialmetrics.operators.derive import type_and_derive
    from dialmetrics.params import REFERENCE
    from dialmetrics.sources.extract import conform_extract

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        raw = conform_extract(spark.createDataFrame(
            [(1, "Z", "2018-03-25 02:30:05")], "CASE_ID_T long, SEGMENT string, CALLPLACEDTIME string"))
        r = type_and_derive(raw, REFERENCE).select(
            "placed_time", "placed_moment", "placed_hour", "placed_date", "dialer_tweak",
            S.ntz_text("placed_time").alias("txt")).first()
        assert r.placed_moment == "02:30:05" and r.placed_hour == 2 and r.txt == "2018-03-25 02:30:05"
        assert r.placed_date == dt.date(2018, 3, 25) and r.dialer_tweak == "tweak"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_timestamp_needs_a_full_clock_time(spark):
    df = spark.createDataFrame([("2024-01-03 10:11",), ("2024-01-03T10:11:12",), ("2024-02-30 10:11:12",),
                                ("2024-01-03 10:11:12",)], "t string")
    got = [r.ts for r in df.select(S.parse_timestamp("t").alias("ts")).collect()]
    assert got[0] is None and got[1] == dt.datetime(2024, 1, 3, 10, 11, 12)
    assert got[2] is None and got[3] == dt.datetime(2024, 1, 3, 10, 11, 12)
