"""Bases and bitmaps: the additive reports from four reads, with the results of the attempts."""

import pytest
from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from dialmetrics.operators.metrics import benefit, benefit_grain, benefit_sets
from dialmetrics.params import FIXTURE
from dialmetrics.plans import lattice
from dialmetrics.plans import reports as R
from dialmetrics.plans.registry import REPORTS, load_attempts
from dialmetrics.sources.store import read_attempts, write_attempts

STORED = FIXTURE.with_(renumber_first_attempts=False)


def rows(df):
    return df.dtypes, canon([tuple(r) for r in df.collect()], df.columns)


def odd(df):
    """Missing ids, flags, talk times, days and negative ids."""
    return df.withColumns({
        "id": F.when(F.col("event_id") % 11 != 1, F.col("id") - 40),
        "is_contact": F.when((F.col("event_id") % 13 != 1) | (F.col("segs") != "A"), F.col("is_contact")),
        "is_sale": F.when((F.col("event_id") % 17 != 1) | (F.col("placed_hour") > 9), F.col("is_sale")),
        "length": F.when(F.col("event_id") % 7 != 1, F.col("length"))})


def leaves(df):
    """What a plan reads: kinds of its leaves, with what is cached in place."""
    found = df._jdf.queryExecution().withCachedData().collectLeaves()
    return [found.apply(i).getClass().getSimpleName() for i in range(found.size())]


def test_bases_read_the_table_four_times_and_give_the_same_reports(spark, tmp_path):
    """Every additive report reads cached bases only, of which there are four with one scan each."""
    path = str(tmp_path / "attempts")
    write_attempts(odd(load_attempts(spark, SF001, FIXTURE)), path, num_partitions=2)
    stored = read_attempts(spark, path)
    names = [n for n in REPORTS if n in lattice.NEEDS or n in lattice.BENEFIT]
    assert len(names) == len(lattice.NEEDS) + len(lattice.BENEFIT) == 38
    with R.shared_aggregates():
        want = {n: rows(REPORTS[n][0](stored, STORED)) for n in names}
    with R.shared_aggregates(), lattice.Lattice(stored, names) as bases:
        for n in names:
            made = REPORTS[n][0](bases.source(n), STORED)
            assert set(leaves(made)) == {"InMemoryRelation"}, n
            assert rows(made) == want[n], n
        read = [df for df, _ in R._SHARED.values() if df is stored]
        assert len(bases.held) == 3 and len(read) == 1 and list(R._SHARED[id(stored)][1]) == [("benefit 7", STORED)]
    assert not bases.held


@pytest.mark.parametrize("name", list(lattice.BASES))
def test_a_base_scans_once_and_only_its_columns(spark, tmp_path, name):
    path = str(tmp_path / "attempts")
    write_attempts(load_attempts(spark, SF001, FIXTURE), path, num_partitions=2)
    plan = lattice.base(read_attempts(spark, path), name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "result:string" not in plan.split("ReadSchema")[1]


def test_needs_are_what_the_reports_read(spark):
    """Each report runs on a frame of just the columns that it is said to need."""
    df = load_attempts(spark, SF001, FIXTURE, numbered=False).withColumn("no_birth", F.lit(0))
    for name, need in lattice.NEEDS.items():
        extra = ["length"] if name.startswith(("sales_", "hours_", "talk_")) else []
        R.clear_shared()
        assert REPORTS[name][0](df.select(*dict.fromkeys([*need, *extra])), FIXTURE).columns
    R.clear_shared()
    with pytest.raises(ValueError, match="no base"):
        lattice.NEEDS["other"] = ["id", "placed_hour"]
        try:
            lattice.cover(["other"])
        finally:
            del lattice.NEEDS["other"]


def test_bitmap_records_equal_distinct_counts(spark):
    df = odd(load_attempts(spark, SF001, FIXTURE, numbered=False))
    grains = [["segs", "placed_week"], ["pilot_cat"], [], ["placed_hour", "segs"]]
    sets = benefit_sets(df, grains)
    for i, keys in enumerate(grains):
        assert rows(benefit_grain(sets, grains, i)) == rows(benefit(df, keys)), keys
    far = spark.createDataFrame([(k, 1, 0, "A") for k in (-2 ** 63, 2 ** 63 - 1, -1, 0, 63, 64, 64)] + [(None, 1, None, "A")] * 2,
                                "id long, is_contact int, is_sale int, segs string")
    got = benefit_grain(benefit_sets(far, [["segs"]]), [["segs"]], 0).first()
    assert (got.records, got.attempts, got.contacts, got.sales) == (7, 9, 9, None)
    assert benefit_grain(benefit_sets(far.limit(0), [["segs"]]), [["segs"]], 0).count() == 0


def test_total_of_no_attempts(spark):
    none = load_attempts(spark, SF001, FIXTURE, numbered=False).limit(0)
    got = R.benefit_total(none, FIXTURE).collect()
    assert [(r.records, r.attempts, r.contacts, r.sales) for r in got] == [(0, 0, 0, 0)]
