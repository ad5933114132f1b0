"""The attempts clustered by case: a bucketed table for reports that follow cases.

``store.py`` lays attempts out by day, for reports of a period. Here they are bucketed by
case and sorted by time, so that what a report does per case (number its attempts, take its
first ones, count by case) needs no exchange: the scan delivers each case whole. A look-up
of cases reads their buckets only.

A case of more than ``hot_rows`` attempts, and the attempts without a case, would make one
task as long as they are. They are kept beside the buckets, laid out by (case, time), and
numbered by (case, hour) (``operators.numbering``). Which cases those are is found by one
count per case while writing; at most rows / ``hot_rows`` of them.

The table is an external one under ``path``: a session that does not know it yet registers
it from ``path`` and the number of buckets, which the folder's name carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_attempts, time_order
from .store import ATTEMPTS_SCHEMA

BUCKETS = 200
HOT_ROWS = 1_000_000
COLUMNS = [f for f in ATTEMPTS_SCHEMA.fields if f.name != "attempt_no"]
SORTED_BY = ["id", "placed_time", "event_id"]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _register(spark: SparkSession, path: str, table: str, buckets: int) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COLUMNS)
    spark.sql(f"DROP TABLE IF EXISTS {table}")      # an external table: its files stay
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY ({', '.join(SORTED_BY)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}/buckets={buckets}'")


def write_clustered(attempts: DataFrame, path: str, table: str, buckets: int = BUCKETS, hot_rows: int = HOT_ROWS) -> None:
    """Write the attempts as table ``table`` with its files under ``path``; ``path`` must be new."""
    spark = attempts.sparkSession
    if _exists(spark, path):
        raise ValueError(f"{path} exists; a clustered store is written once")
    rows = attempts.select(*[f.name for f in COLUMNS])
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    # with the missing case, which no join by id would meet
    counts.where((F.col("n") > hot_rows) | F.col("id").isNull()).select("id").write.parquet(f"{path}/hot_cases")
    hot = spark.read.schema("id long").parquet(f"{path}/hot_cases")
    usual = rows.where("id IS NOT NULL").join(hot, "id", "left_anti")
    # partitioned as the buckets are: one file for each
    (usual.repartition(buckets, "id").sortWithinPartitions(*SORTED_BY).write.format("parquet")
     .bucketBy(buckets, "id").sortBy(*SORTED_BY).option("path", f"{path}/buckets={buckets}").mode("errorifexists").saveAsTable(table))
    if not hot.isEmpty():
        large = rows.where("id IS NULL").unionByName(rows.where("id IS NOT NULL").join(hot, "id", "left_semi").select(*rows.columns))
        large.repartitionByRange(*SORTED_BY).sortWithinPartitions(*SORTED_BY).write.parquet(f"{path}/hot")


def _usual(spark: SparkSession, path: str, table: str) -> DataFrame:
    if not spark.catalog.tableExists(table):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(root)]
        _register(spark, path, table, next(int(n.split("=")[1]) for n in names if n.startswith("buckets=")))
    return spark.table(table)


def _hot(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, f"{path}/hot"):
        return None
    return spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COLUMNS)).parquet(f"{path}/hot")


def per_case(spark: SparkSession, path: str, table: str, usual, hot) -> DataFrame:
    """``usual(df)`` of the clustered cases and ``hot(df)`` of the others, which share no case."""
    found, large = usual(_usual(spark, path, table)), _hot(spark, path)
    return found if large is None else found.unionByName(hot(large))


def read_clustered(spark: SparkSession, path: str, table: str, missing: str = "null") -> DataFrame:
    """All attempts with their number (W01; ``missing="last"``: W02), in the usual columns."""
    names = [f.name for f in ATTEMPTS_SCHEMA.fields]

    def number(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(*time_order(df)))
        return df.withColumn("attempt_no", F.when(F.col("placed_time").isNotNull(), rank) if missing == "null" else rank)

    return per_case(spark, path, table, lambda df: number(df).select(*names),
                    lambda df: number_attempts(df, missing=missing).select(*names))


def cases(spark: SparkSession, path: str, table: str, ids) -> DataFrame:
    """The numbered attempts of some cases: their buckets are read, and no others."""
    return read_clustered(spark, path, table, "last").where(F.col("id").isin(*ids))
