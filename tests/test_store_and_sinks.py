import os

from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from dialmetrics.params import FIXTURE
from dialmetrics.plans import reports as R
from dialmetrics.plans.registry import load_attempts
from dialmetrics.sources.dictionary import data_dictionary
from dialmetrics.sources.fixture import raw_extract
from dialmetrics.sources.sinks import write_report
from dialmetrics.sources.store import read_attempts, write_attempts
from dialmetrics.streaming import landed_attempts, start_landing


def _same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert canon([tuple(r) for r in a.collect()], a.columns) == canon([tuple(r) for r in b.collect()], b.columns)


def test_stored_attempts_give_same_reports_and_prune_dates(spark, tmp_path):
    live = load_attempts(spark, SF001, FIXTURE)
    path = str(tmp_path / "attempts")
    write_attempts(live, path, num_partitions=4)
    stored = read_attempts(spark, path)
    _same(live, stored)
    stored_p = FIXTURE.with_(renumber_first_attempts=False)
    for fn in (R.benefit_segs_week_long, R.attempt_sequences, R.talk_time_share, R.hour_rates,
               R.attempt_dist, R.birth_missing_cases, R.attempt_counts_long):
        _same(fn(live, FIXTURE), fn(stored, FIXTURE))
        _same(fn(live, FIXTURE), fn(stored, stored_p))
    plan = R.dials_by_date(stored, FIXTURE)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(placed_date" in plan and "2024-01-11" in plan


def test_write_report_csv_writes_na(spark, tmp_path):
    df = spark.createDataFrame([("A", None), ("C", 1.5)], "segs string, v double")
    out = str(tmp_path / "rep")
    write_report(df, out, single_file=True)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text.splitlines()[0] == "segs,v" and "A,NA" in text


def test_dictionary(spark):
    df = load_attempts(spark, SF001, FIXTURE, numbered=False).select("id", "segs", "length", "result_cat")
    d = {r.variable_name: r for r in data_dictionary(
        df, {"id": "case"}, {"segs": 1, "result_cat": 1}).collect()}
    assert d["id"].description == "case" and d["id"].min is not None
    assert d["segs"].n_distinct == df.select("segs").distinct().count()
    assert d["result_cat"].n_distinct > 3 and d["segs"].min is None
    assert d["length"].n_missing == df.where(F.col("length").isNull()).count()


def test_stream_landing_matches_batch(spark, tmp_path):
    raw_dir, out_dir, ck = (str(tmp_path / n) for n in ("raw", "landed", "ckpt"))
    raw = raw_extract(spark, SF001)
    raw.where(F.col("event_id") % 2 == 0).write.parquet(raw_dir + "/part1")
    raw.where(F.col("event_id") % 2 == 1).write.parquet(raw_dir + "/part2")
    q = start_landing(spark, raw_dir + "/*", out_dir, ck, FIXTURE, max_files_per_trigger=1)
    q.awaitTermination(120)
    _same(landed_attempts(spark, out_dir, FIXTURE), load_attempts(spark, SF001, FIXTURE))


def test_runner_writes_every_report(spark, tmp_path):
    from dialmetrics.plans.registry import REPORTS
    from dialmetrics.plans.runner import main

    out = str(tmp_path / "reports")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    main(["--tables", SF001, "--params", "fixture", "--out", out, "--format", "parquet",
          "--report", "benefit_segs", "--report", "benefit_segs_weeks_v1", "--report", "talk_time_share"])
    assert sorted(os.listdir(out)) == ["benefit_segs", "benefit_segs_weeks_v1", "talk_time_share"]
    assert spark.read.parquet(os.path.join(out, "benefit_segs")).count() > 0
    assert len(REPORTS) == 50
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached   # nothing stays cached


def test_params_from_text():
    from dialmetrics.params import REFERENCE

    p = REFERENCE.with_text(["cut=2024-01-11", "months=1,2", "case_ids=0,4", "attempt_cap=11",
                             "contact_share_min=0.1", "segments=A,Z", "week_columns=none",
                             "renumber_first_attempts=false"])
    assert p.cut == "2024-01-11" and p.months == (1, 2) and p.case_ids == (0, 4)
    assert p.attempt_cap == 11 and p.contact_share_min == 0.1 and p.segments == ("A", "Z")
    assert p.week_columns is None and p.renumber_first_attempts is False
    assert REFERENCE.with_text(["case_ids=none"]).case_ids is None


def test_store_splits_a_hot_case_over_tasks(spark, tmp_path):
    """One case holding a third of all attempts, all on one day, is written by several tasks."""
    live = load_attempts(spark, SF001, FIXTURE, numbered=False)
    hot = live.withColumn("id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("id")))
    day = hot.where(F.col("placed_date") == F.lit("2024-01-15").cast("date"))
    path = str(tmp_path / "hot")
    write_attempts(day, path, num_partitions=6)
    per_file = (read_attempts(spark, path).where(F.col("id") == 7)
                .groupBy(F.input_file_name()).count().collect())
    total = sum(r["count"] for r in per_file)
    assert len(per_file) >= 2 and max(r["count"] for r in per_file) < total


def test_dictionary_from_positional_lists(spark):
    df = spark.createDataFrame([(1, "A"), (2, "Z"), (3, "Z")], "id long, segs string")
    d = {r.variable_name: r for r in data_dictionary(df, ["case", "segment"], [0, 1]).collect()}
    assert d["segs"].description == "segment" and d["segs"].n_distinct == 2
    assert d["id"].min == "1" and d["id"].max == "3"


def test_dictionary_lists_every_value(spark):
    """A column of 30 values has 30 rows, with nulls a row of their own."""
    from dialmetrics.sources.dictionary import dictionary_values

    df = spark.createDataFrame([(f"v{i}", i % 2) for i in range(30)] + [("v0", None), (None, 1)], "a string, b int")
    got = {(r.variable_name, r.value): r.rows for r in dictionary_values(df, ["a", "b"]).collect()}
    assert got[("a", "v0")] == 2 and got[("a", None)] == 1 and got[("b", None)] == 1
    assert len([k for k in got if k[0] == "a"]) == 31
    d = {r.variable_name: r for r in data_dictionary(df, var_types={"a": 1}).collect()}
    assert d["a"].n_distinct == 31 and d["a"].n_missing == 1


def test_every_report_runs_on_the_fourteen_column_extract(spark, tmp_path):
    """The original's own extract has no event id: ties are broken by the other columns,
    and the numbers repeat from run to run."""
    from dialmetrics.operators.derive import derive_attempts
    from dialmetrics.plans.registry import REPORTS
    from dialmetrics.plans.runner import run_all
    from dialmetrics.sources.extract import RAW_COLUMNS, load_extract_parquet
    from dialmetrics.sources.fixture import raw_extract

    path = str(tmp_path / "extract")
    raw_extract(spark, SF001).select(*RAW_COLUMNS).repartition(5).write.parquet(path)
    attempts = derive_attempts(load_extract_parquet(spark, path), FIXTURE)
    assert "event_id" not in attempts.columns
    names = ["attempts", "case_history", "case_history_shared", "cases_history", "attempt_dist", "uncategorised"]
    written = run_all(attempts, FIXTURE, str(tmp_path / "out"), "parquet", names=names)
    assert len(written) == len(names) and set(names) <= set(REPORTS)
    again = derive_attempts(load_extract_parquet(spark, path).repartition(3), FIXTURE)
    _same(attempts, again)


def test_views_are_listed_by_sparks_file_system(spark):
    import pytest

    from dialmetrics.plans.runner import register_views

    assert "events" in register_views(spark, f"file://{SF001}")
    with pytest.raises(Exception):
        register_views(spark, "file:///nowhere/at/all")


def test_jdbc_in_one_task_has_to_be_asked_for(spark, tmp_path):
    import pytest

    from dialmetrics.plans.runner import main
    from dialmetrics.sources.extract import load_extract_jdbc

    with pytest.raises(ValueError, match="one task"):
        load_extract_jdbc(spark, "jdbc:none://nowhere", "SELECT 1")
    with pytest.raises(SystemExit):
        main(["--sql", "x.sql", "--jdbc-url", "jdbc:none://nowhere", "--out", str(tmp_path)])


def test_case_reports_push_the_id_filter_to_the_store(spark, tmp_path):
    path = str(tmp_path / "attempts")
    write_attempts(load_attempts(spark, SF001, FIXTURE), path, num_partitions=4)
    stored = read_attempts(spark, path)
    p = FIXTURE.with_(case_id=(0, 4, 8))
    for fn in (R.case_history, R.cases_history):
        out = fn(stored, p)
        assert {r.id for r in out.select("id").distinct().collect()} <= {0, 4, 8}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(id, [0,4,8])" in plan or "In(id" in plan.split("PushedFilters:")[1][:200]
