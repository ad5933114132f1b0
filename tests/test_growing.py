"""The growing store: loads in any order equal one batch, and read no more than they need."""

import os

import pytest
from pyspark.sql import functions as F

from compare import canon
from conftest import SF001
from dialmetrics.params import FIXTURE
from dialmetrics.plans import reports as R
from dialmetrics.plans.registry import load_attempts
from dialmetrics.sources.fixture import raw_extract
from dialmetrics.sources.growing import _hours, append_load, create_store, read_grown, snapshot


def rows(df):
    return canon([tuple(r) for r in df.collect()], df.columns)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


@pytest.fixture(scope="module")
def raw(spark):
    return raw_extract(spark, SF001).withColumn("day", F.substring("CALLPLACEDTIME", 1, 10))


@pytest.fixture(scope="module")
def grown(spark, raw, tmp_path_factory):
    """Day by day, with late attempts of all days and those without a time at the end."""
    path = str(tmp_path_factory.mktemp("grown") / "store")
    create_store(spark, path, FIXTURE, buckets=16)
    late = (F.col("event_id") % 10 == 3) | F.col("day").isNull()
    days = sorted(r.day for r in raw.where(~late).select("day").distinct().collect())
    for a in range(0, len(days), 16):        # runs of days, to spare time
        append_load(raw.where(~late & F.col("day").isin(days[a:a + 16])), path, FIXTURE, f"days {a}")
    append_load(raw.where(late), path, FIXTURE, "late")
    return path


def test_loads_equal_one_batch(spark, grown):
    live = load_attempts(spark, SF001, FIXTURE)
    stored = read_grown(spark, grown, FIXTURE)
    assert stored.columns == live.columns and rows(stored) == rows(live)
    for fn in (R.benefit_segs, R.attempt_dist, R.hour_rates):
        assert rows(fn(stored, FIXTURE.with_(renumber_first_attempts=False))) == rows(fn(live, FIXTURE))


def test_numbered_table_reads_the_rows_once(spark, grown):
    plan = read_grown(spark, grown, FIXTURE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("/rows") >= 1 and plan.count("Window [") == 1
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert sum("_dm_before" in x for x in scans) == 1       # rows once, stored offsets once
    bare = read_grown(spark, grown, FIXTURE, numbered=False)._jdf.queryExecution().executedPlan().toString()
    assert bare.count("FileScan parquet") == 1 and "Window" not in bare


def test_stored_offsets_are_merged_not_broadcast(spark, grown):
    plan = read_grown(spark, grown, FIXTURE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


def test_a_load_reads_and_writes_what_it_touches(spark, raw, grown):
    before, snap = files(grown), snapshot(spark, grown)
    case = raw.where("CASE_ID_T = 4").limit(1).withColumn("event_id", F.lit(10 ** 9)).withColumn(
        "CALLPLACEDTIME", F.lit("2024-01-02 00:00:01"))
    after = append_load(case, grown, FIXTURE, "one attempt")
    changed = [b for b in range(16) if after.versions[b] != snap.versions[b]]
    assert len(changed) == 1
    held = _hours(spark, grown, snap, changed)
    assert len(held.inputFiles()) < len(_hours(spark, grown, snap).inputFiles())
    now = files(grown)
    assert all(now[f] == t for f, t in before.items())      # nothing that was there is written again
    new = [f for f in now if f not in before and f.endswith(".parquet")]
    assert len([f for f in new if "/rows/" in f]) == 1 and {f.split("bucket=")[1].split("/")[0] for f in new if "/hours/" in f} == {str(changed[0])}
    numbers = [r.attempt_no for r in read_grown(spark, grown, FIXTURE).where("id = 4 AND attempt_no IS NOT NULL").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    assert append_load(case, grown, FIXTURE, "one attempt").version == after.version       # by name, once


def test_replaced_days(spark, raw, tmp_path):
    path = str(tmp_path / "store")
    create_store(spark, path, FIXTURE, buckets=4)
    append_load(raw, path, FIXTURE, "all")
    kept = files(path)
    day = "2024-01-12"
    short = raw.where((F.col("day") == day) & (F.col("event_id") % 2 == 0))
    append_load(short, path, FIXTURE, "again", replaces=[day])
    want = load_attempts(spark, SF001, FIXTURE, numbered=False).where(
        f"placed_date IS NULL OR placed_date <> DATE '{day}' OR event_id % 2 = 0")
    from dialmetrics.operators.numbering import number_attempts

    assert rows(read_grown(spark, path, FIXTURE)) == rows(number_attempts(want).select(*read_grown(spark, path, FIXTURE).columns))
    assert all(files(path)[f] == t for f, t in kept.items())


def test_other_rules_raise_and_failed_loads_leave_no_trace(spark, raw, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    create_store(spark, path, FIXTURE, buckets=4)
    assert read_grown(spark, path, FIXTURE).count() == 0
    append_load(raw.where("event_id % 2 = 0"), path, FIXTURE, "even")
    with pytest.raises(ValueError, match="cut"):
        read_grown(spark, path, FIXTURE.with_(cut="2024-01-20"))
    with pytest.raises(ValueError, match="control"):
        append_load(raw, path, FIXTURE.with_(control_segments=("A",)), "x")
    import dialmetrics.sources.growing as G

    want, publish = rows(read_grown(spark, path, FIXTURE)), G._publish

    def lost(*args):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(G, "_publish", lost)
    with pytest.raises(RuntimeError):
        append_load(raw.where("event_id % 2 = 1"), path, FIXTURE, "odd")
    monkeypatch.setattr(G, "_publish", publish)
    assert rows(read_grown(spark, path, FIXTURE)) == want
    append_load(raw.where("event_id % 2 = 1"), path, FIXTURE, "odd")
    assert rows(read_grown(spark, path, FIXTURE)) == rows(load_attempts(spark, SF001, FIXTURE))
    append_load(raw.limit(0), path, FIXTURE, "empty")
    assert read_grown(spark, path, FIXTURE).count() == raw.count()
    with pytest.raises(RuntimeError, match="another job"):
        G._publish(spark, path, snapshot(spark, path))


def test_runner_grows_a_store(spark, raw, tmp_path):
    from dialmetrics.plans.runner import main

    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    for name, part in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1"), ("b", "event_id % 2 = 1")):
        raw.where(part).drop("day").write.mode("overwrite").parquet(str(tmp_path / "extract"))
        main(["--parquet", str(tmp_path / "extract"), "--params", "fixture", "--grow", store, "--load", name, "--buckets", "4",
              "--out", out, "--format", "parquet", "--report", "attempts"])
    assert rows(spark.read.parquet(out + "/attempts")) == rows(load_attempts(spark, SF001, FIXTURE))
    with pytest.raises(SystemExit):
        main(["--parquet", "x", "--grow", store, "--out", out])


def test_lost_texts_are_counted_where_they_are_written(spark, raw, tmp_path):
    """Bad texts count once each, though the write's range partitioning reads its input twice."""
    from dialmetrics.operators.derive import derive_attempts
    from dialmetrics.operators.losses import PARSERS, loss_report
    from dialmetrics.sources.growing import load_losses
    from dialmetrics.sources.store import read_attempts, write_attempts

    bad = raw.drop("day").withColumns({
        "CALLPLACEDTIME": F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).otherwise(F.col("CALLPLACEDTIME")),
        "IS_SALE": F.when(F.col("event_id") % 4 == 0, F.lit("yes")).otherwise(F.col("IS_SALE"))})
    want = {r.variable_name: (r.texts, r.lost) for r in loss_report(bad).collect()}
    ids = [r.event_id for r in raw.select("event_id").collect()]
    assert want["is_sale"] == (len(ids), sum(i % 4 == 0 for i in ids)) and want["placed_time"][1] == sum(i % 5 == 0 for i in ids)
    assert list(want) == list(PARSERS) and want["sub_start_date"][1] == 0 < want["date_of_birth"][1]
    derived = derive_attempts(bad, FIXTURE, losses=True)
    assert write_attempts(derived, str(tmp_path / "attempts"), num_partitions=3) == want
    assert rows(read_attempts(spark, str(tmp_path / "attempts"))) == rows(derive_attempts(bad, FIXTURE))
    path = str(tmp_path / "store")
    create_store(spark, path, FIXTURE, buckets=2)
    append_load(bad.where("event_id % 2 = 0"), path, FIXTURE, "even")
    append_load(bad.where("event_id % 2 = 1"), path, FIXTURE, "odd")
    append_load(bad.limit(0), path, FIXTURE, "none")
    per_load = load_losses(spark, path).collect()
    for name in PARSERS:
        mine = [(r.texts, r.lost) for r in per_load if r.variable_name == name]
        assert len(mine) == 3 and tuple(map(sum, zip(*mine))) == want[name] and mine[2] == (0, 0)


def test_landed_files_are_loads(spark, raw, tmp_path):
    """Each landed folder is loaded once, in several calls, and what is still being written is left."""
    from dialmetrics.sources.growing import append_landed, load_names

    path, folder = str(tmp_path / "store"), tmp_path / "raw"
    create_store(spark, path, FIXTURE, buckets=2)
    part = raw.drop("day")
    part.where("event_id % 3 = 1").write.parquet(str(folder / "b"))
    part.where("event_id % 3 = 0").write.parquet(str(folder / "a"))
    part.where("event_id % 3 = 2").write.parquet(str(folder / "_c"))
    assert append_landed(spark, str(folder), path, FIXTURE) == ["a", "b"]
    part.where("event_id % 3 = 2").write.parquet(str(folder / "c"))
    assert append_landed(spark, str(folder), path, FIXTURE) == ["c"]
    assert append_landed(spark, str(folder), path, FIXTURE) == [] and load_names(spark, path) == ["a", "b", "c"]
    assert rows(read_grown(spark, path, FIXTURE)) == rows(load_attempts(spark, SF001, FIXTURE))
