"""The attempts table written once and read by every report.

At scale the extract is derived (and every attempt numbered) in one job and
landed as parquet partitioned by ``placed_date``; reports then read only the
partitions they need: the period filter ``placed_date >= cut`` becomes a
partition filter, and column pruning reads only the columns a report uses.

Writing: rows are range-partitioned on (placed_date, id, placed_time, event_id)
before the write, so
task sizes are even even when one day or one case holds a large share of all
rows, each task writes few date folders, and files are sorted by case id
(tight row-group statistics for case lookups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.losses import LOST, losses_of, observed

ATTEMPTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("customer", T.LongType()),
    T.StructField("segs", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("customer_att", T.StringType()),
    T.StructField("sub", T.StringType()),
    T.StructField("sub_start_date", T.DateType()),
    T.StructField("date_of_birth", T.StringType()),
    T.StructField("placed_time", T.TimestampNTZType()),
    T.StructField("answered_time", T.TimestampNTZType()),
    T.StructField("length", T.LongType()),
    T.StructField("is_contact", T.IntegerType()),
    T.StructField("is_sale", T.IntegerType()),
    T.StructField("result", T.StringType()),
    T.StructField("placed_date", T.DateType()),
    T.StructField("placed_week", T.IntegerType()),
    T.StructField("placed_month", T.IntegerType()),
    T.StructField("placed_moment", T.StringType()),
    T.StructField("placed_hour", T.IntegerType()),
    T.StructField("dialer_tweak", T.StringType()),
    T.StructField("pilot_cat", T.StringType()),
    T.StructField("result2", T.StringType()),
    T.StructField("result_cat", T.StringType()),
    T.StructField("attempt_no", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
])


def write_attempts(df: DataFrame, path: str, rows_per_file: int = 5_000_000,
                   num_partitions: int | None = None, mode: str = "overwrite") -> dict | None:
    """Land the attempts table partitioned by ``placed_date``.

    Of a table with the mask of lost texts (``derive_attempts(losses=True)``) the mask is
    counted on the way and not written; returns (texts, lost) by column.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range key ends in (time, tie) so even one hot case on one day is split
    order = [F.col("placed_date"), F.col("id"), F.col("placed_time")]
    order += [F.col(c) for c in ("event_id",) if c in df.columns]
    landed, counts = df.repartitionByRange(n, *order).sortWithinPartitions(*order), None
    if LOST in df.columns:
        counts = Observation()
        landed = observed(landed, counts)
    (landed.write.mode(mode)
     .option("maxRecordsPerFile", rows_per_file)
     .partitionBy("placed_date")
     .parquet(path))
    return losses_of(counts) if counts else None


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The stored attempts table, columns in their usual order."""
    df = spark.read.schema(ATTEMPTS_SCHEMA).parquet(path)
    return df.select(*[f.name for f in ATTEMPTS_SCHEMA.fields])
