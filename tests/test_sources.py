from pyspark.sql import functions as F

from conftest import SF001
from dialmetrics.sources.extract import RAW_COLUMNS, clean_query_text, conform_extract, load_extract_sql
from dialmetrics.sources.fixture import raw_extract


def test_clean_query_text_keeps_lines_apart():
    assert clean_query_text("SELECT a\r\nFROM t\nWHERE x = 1;\n") == "SELECT a\nFROM t\nWHERE x = 1"
    assert clean_query_text(["SELECT a -- note", "FROM t"]) == "SELECT a -- note\nFROM t"


def test_conform_adds_missing_columns_typed(spark):
    df = spark.createDataFrame([(1, "A", 5)], "CASE_ID_T int, SEGMENT string, event_id long")
    out = conform_extract(df)
    assert out.columns == RAW_COLUMNS + ["event_id"]
    assert dict(out.dtypes)["LENGTH"] == "bigint" and dict(out.dtypes)["CASE_ID_T"] == "bigint"
    assert out.first().LENGTH is None


def test_load_by_sql_text_over_views(spark, tmp_path):
    raw_extract(spark, SF001).createOrReplaceTempView("dial_extract")
    sql = tmp_path / "extract.sql"
    sql.write_text("SELECT *\nFROM dial_extract\nWHERE SEGMENT = 'Z'\n")
    df = load_extract_sql(spark, str(sql))
    assert df.columns == RAW_COLUMNS + ["event_id"]
    assert df.count() == raw_extract(spark, SF001).where(F.col("SEGMENT") == "Z").count() > 0


def test_older_extract_has_no_length_and_fewer_customers(spark):
    new, old = raw_extract(spark, SF001), raw_extract(spark, SF001, min_acctbal=0, with_length=False)
    assert old.where(F.col("LENGTH").isNotNull()).count() == 0
    assert old.count() <= new.count()


def test_conform_matches_names_regardless_of_case(spark):
    df = spark.createDataFrame([(5, "z", "1", 9)], "case_id_t long, segment string, Is_Sale string, EVENT_ID long")
    r = conform_extract(df).first()
    assert r.CASE_ID_T == 5 and r.SEGMENT == "z" and r.IS_SALE == "1" and r.event_id == 9


def test_sql_file_extract_equals_dataframe_extract(spark):
    """S01 end to end: the fixture extract as a .sql file over views equals the DataFrame build."""
    import os

    from compare import canon
    from conftest import ROOT
    from dialmetrics.plans.runner import register_views

    assert {"events", "customer", "nation", "orders"} <= set(register_views(spark, SF001))
    a = load_extract_sql(spark, os.path.join(ROOT, "examples", "fixture_extract.sql"))
    b = raw_extract(spark, SF001)
    assert a.dtypes == b.dtypes
    assert canon([tuple(r) for r in a.collect()], a.columns) == canon([tuple(r) for r in b.collect()], b.columns)


def test_jdbc_partitioning_needs_bounds(spark):
    import pytest

    from dialmetrics.sources.extract import load_extract_jdbc

    with pytest.raises(ValueError):
        load_extract_jdbc(spark, "jdbc:none://nowhere", "SELECT 1", partition_column="CASE_ID_T")


def test_times_in_other_forms(spark):
    from pyspark.sql import functions as F

    from dialmetrics.functions.semantics import parse_timestamp

    good = ["2018-03-12 09:05:00", "2018-03-12 9:05:00", "2018-3-12 09:05:00", "2018/03/12 09:05:00",
            "20180312 090500", "20180312090500", "2018-03-12T09:05:00"]
    bad = ["2018-03-12", "20180312", "2018-13-12 09:05:00", "12-03-2018 09:05:00", "x", "", None, "2018-03-12 09:05"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", parse_timestamp("t").alias("p"))
    for r in df.collect():
        assert (str(r.p) == "2018-03-12 09:05:00") if r.t in good else r.p is None, r


def test_flags_delivered_as_booleans(spark):
    from pyspark.sql import functions as F

    from dialmetrics.functions.semantics import to_int
    from dialmetrics.sources.extract import conform_extract

    df = spark.createDataFrame([(True, False), (None, True)], "ISCONTACT boolean, is_sale boolean")
    out = conform_extract(df).select(to_int("ISCONTACT").alias("c"), to_int("IS_SALE").alias("s"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0), (None, 1)]
