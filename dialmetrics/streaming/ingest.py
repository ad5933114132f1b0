"""Incremental landing of extract files with Structured Streaming.

The original works on one extract loaded at once; there is no streaming
operator to rebuild. What streams naturally is the row-wise part of P01:
new extract files dropped in a folder are typed and derived as they arrive
and appended to a ``placed_date``-partitioned parquet table. The attempt
number needs every attempt of a case, so it is added when the landed table is
read (``landed_attempts``), as a batch window over the whole table. A table that is
read more often than it grows is better kept as a growing store
(``sources.growing.append_landed``): each landed file is a load, and reading joins
stored offsets.

The checkpoint location must be a shared, durable folder: it holds the stream's
progress, so a restarted or moved driver carries on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.derive import ATTEMPT_COLUMNS, type_and_derive
from ..operators.numbering import number_attempts
from ..params import Params
from ..sources.extract import RAW_SCHEMA, conform_extract

LANDED_COLUMNS = [c for c in ATTEMPT_COLUMNS if c != "attempt_no"] + ["event_id"]


def raw_stream_schema() -> T.StructType:
    return T.StructType(RAW_SCHEMA.fields + [T.StructField("event_id", T.LongType())])


def start_landing(spark: SparkSession, raw_dir: str, out_dir: str, checkpoint_location: str,
                  params: Params, fmt: str = "parquet", available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream: raw extract files in ``raw_dir`` -> typed rows in ``out_dir``.

    ``available_now=True`` processes what is there (in bounded batches) and stops;
    otherwise the query keeps running and picks up new files.
    """
    reader = spark.readStream.schema(raw_stream_schema()).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    typed = type_and_derive(conform_extract(reader.load(raw_dir)), params).select(*LANDED_COLUMNS)
    writer = (typed.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint_location)
              .partitionBy("placed_date"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out_dir)


def landed_attempts(spark: SparkSession, out_dir: str, params: Params) -> DataFrame:
    """The landed rows with the attempt number over each case's full history."""
    df = spark.read.parquet(out_dir).withColumn("placed_date", F.col("placed_date").cast("date"))
    df = number_attempts(df, "id", "placed_time", missing="null")
    return df.select(*ATTEMPT_COLUMNS, "event_id")
