"""The case-clustered table: same results, no exchange by case, hot cases beside the buckets."""

import pytest
from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from dialmetrics.operators.numbering import first_attempts, number_attempts
from dialmetrics.params import FIXTURE
from dialmetrics.plans import reports as R
from dialmetrics.plans.registry import load_attempts
from dialmetrics.sources.clustered import cases, per_case, read_clustered, write_clustered

STORED = FIXTURE.with_(renumber_first_attempts=False)


def rows(df):
    return canon([tuple(r) for r in df.collect()], df.columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def live(spark):
    return load_attempts(spark, SF001, FIXTURE)


@pytest.fixture(scope="module")
def path(spark, live, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("clustered") / "attempts")
    write_clustered(live, p, "dm_clustered", buckets=8)
    return p


def test_numbers_and_first_attempts_without_an_exchange(spark, live, path):
    stored = read_clustered(spark, path, "dm_clustered")
    assert rows(stored) == rows(live)
    assert "Exchange" not in plan(stored) and plan(stored).count("FileScan") == 1
    first = per_case(spark, path, "dm_clustered", lambda df: first_attempts(df, 4), lambda df: first_attempts(df, 4))
    assert "Exchange" not in plan(first) and "WindowGroupLimit" in plan(first)
    assert rows(first.select("event_id", "attempt_no")) == rows(live.where("attempt_no < 4").select("event_id", "attempt_no"))
    by_case = R.benefit_case(stored, STORED)
    assert "Exchange" not in plan(by_case) and rows(by_case) == rows(R.benefit_case(live, FIXTURE))
    for fn in (R.attempt_dist, R.attempt_sequences, R.birth_missing_cases):
        assert rows(fn(stored, STORED)) == rows(fn(live, FIXTURE)), fn
        assert "hashpartitioning(id" not in plan(fn(stored, STORED))
    R.clear_shared()


def test_case_look_ups_read_their_buckets(spark, live, path):
    found = cases(spark, path, "dm_clustered", [4, 8])
    assert "SelectedBucketsCount: 2 out of 8" in plan(found) or "SelectedBucketsCount: 1 out of 8" in plan(found)
    assert "Exchange" not in plan(found)
    want = number_attempts(live.where("id IN (4, 8)").drop("attempt_no"), missing="last").select(*found.columns)
    assert rows(found) == rows(want)


def test_another_session_registers_the_table(spark, live, path):
    spark.sql("DROP TABLE dm_clustered")        # external: its files stay
    assert rows(read_clustered(spark, path, "dm_clustered")) == rows(live)
    assert "Exchange" not in plan(read_clustered(spark, path, "dm_clustered"))


def test_hot_and_missing_cases_lie_beside_the_buckets(spark, live, tmp_path):
    p = str(tmp_path / "hot")
    hot = live.withColumn("id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).when(F.col("event_id") % 7 == 1, F.lit(None)).otherwise(F.col("id")))
    write_clustered(hot, p, "dm_hot", buckets=4, hot_rows=100)
    assert {r.id for r in spark.read.parquet(p + "/hot").select("id").distinct().collect()} >= {7, None}
    usual = spark.table("dm_hot").groupBy("id").count().agg(F.max("count")).first()[0]
    assert usual <= 100
    for missing in ("null", "last"):
        got = read_clustered(spark, p, "dm_hot", missing)
        assert rows(got) == rows(number_attempts(hot, missing=missing).select(*got.columns))
    with pytest.raises(ValueError, match="exists"):
        write_clustered(hot, p, "dm_other")
    empty = str(tmp_path / "empty")
    write_clustered(live.limit(0), empty, "dm_empty", buckets=2)
    assert read_clustered(spark, empty, "dm_empty").count() == 0
