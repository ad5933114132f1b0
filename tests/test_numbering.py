"""Attempt numbering equals a brute force, whatever the case's size."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialmetrics.operators.numbering import TIE_FALLBACK, first_attempts, number_attempts


def _fixture(spark, seed=7, hours=3):
    rnd = random.Random(seed)
    rows = []
    eid = 0
    # case 1 is large, others small; equal times, missing times and ids, a one-row case
    for case, n in [(1, 300), (2, 5), (3, 1), (4, 12), (None, 40)]:
        for _ in range(n):
            t = None if rnd.random() < 0.1 else (
                pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rnd.choice([0, 1, 3599, 3600, 3601, 7200 * hours])))
            rows.append((case, t.to_pydatetime() if t is not None else None, eid * 40_000))
            eid += 1
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id long, placed_time timestamp_ntz, event_id long")


def _brute(rows, missing):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    for rs in by.values():
        timed = sorted([r for r in rs if r["placed_time"] is not None], key=lambda r: (r["placed_time"], r["event_id"]))
        untimed = sorted([r for r in rs if r["placed_time"] is None], key=lambda r: r["event_id"])
        for i, r in enumerate(timed):
            out[r["event_id"]] = i + 1
        for i, r in enumerate(untimed):
            out[r["event_id"]] = None if missing == "null" else len(timed) + i + 1
    return out


@pytest.mark.parametrize("missing", ["null", "last"])
def test_numbers_match_brute_force(spark, missing):
    df = _fixture(spark)
    rows = [r.asDict() for r in df.collect()]
    out = number_attempts(df, missing=missing)
    assert out.columns == [*df.columns, "attempt_no"] and out.count() == df.count()
    assert {r.event_id: r.attempt_no for r in out.collect()} == _brute(rows, missing)


def test_text_case_ids(spark):
    df = _fixture(spark)
    a = {(r.event_id, r.attempt_no) for r in number_attempts(df).collect()}
    b = {(r.event_id, r.attempt_no) for r in number_attempts(df.withColumn("id", F.col("id").cast("string"))).collect()}
    assert a == b


def test_numbers_are_one_to_n(spark):
    df = number_attempts(_fixture(spark), missing="null")
    chk = (df.where(F.col("attempt_no").isNotNull()).groupBy("id")
           .agg(F.min("attempt_no").alias("lo"), F.max("attempt_no").alias("hi"),
                F.count("*").alias("n"), F.count_distinct("attempt_no").alias("d")).collect())
    for r in chk:
        assert r.lo == 1 and r.hi == r.n == r.d


def test_no_rows(spark):
    assert number_attempts(_fixture(spark).limit(0)).count() == 0


def test_without_an_event_id_the_order_is_repeatable(spark):
    df = _fixture(spark).drop("event_id").withColumn("result", F.lit("x"))
    df = df.withColumn("length", F.when(F.col("placed_time").isNotNull(), F.hash("placed_time") % 3))
    a = sorted(map(str, number_attempts(df, missing="last").collect()))
    b = sorted(map(str, number_attempts(df.repartition(7), missing="last").collect()))
    assert a == b and "result" in TIE_FALLBACK


def test_first_attempts_equal_full_numbering_below_cap(spark):
    df = _fixture(spark)
    for cap in (1, 2, 5, 11, 400):
        full = {(r.event_id, r.attempt_no) for r in number_attempts(df).where(F.col("attempt_no") < cap).collect()}
        got = {(r.event_id, r.attempt_no) for r in first_attempts(df, cap).collect()}
        assert got == full, cap
