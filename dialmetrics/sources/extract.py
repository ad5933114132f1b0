"""Loading the raw dial-attempt extract (S01-S03) and fixing its schema.

The extract is one row per dial attempt with 14 columns as the database
delivers them (ids as numbers, flags and times as text). Sources:

* ``load_extract_sql``     -- SQL text (or a .sql file) run by ``spark.sql`` over
                              registered tables / views
* ``load_extract_jdbc``    -- the same SQL pushed to a database over JDBC, read in
                              parallel slices when a numeric partition column is given
* ``load_extract_parquet`` -- an extract already landed as parquet

Every loader ends in ``conform_extract``: missing columns become typed nulls
(the older extract has no ``LENGTH``), the rest are cast to the raw types.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("CASE_ID_T", T.LongType()),
    T.StructField("KLANTNR", T.LongType()),
    T.StructField("SEGMENT", T.StringType()),
    T.StructField("BATCH_TYPE", T.StringType()),
    T.StructField("CUSTOMER_ATT", T.StringType()),
    T.StructField("CURRENT_SUB", T.StringType()),
    T.StructField("SUB_START_DATE", T.StringType()),
    T.StructField("DATE_OF_BIRTH", T.StringType()),
    T.StructField("CALLPLACEDTIME", T.StringType()),
    T.StructField("CALLANSWEREDTIME", T.StringType()),
    T.StructField("LENGTH", T.LongType()),
    T.StructField("ISCONTACT", T.StringType()),
    T.StructField("IS_SALE", T.StringType()),
    T.StructField("FINISHCODE", T.StringType()),
])
FLAGS = ("ISCONTACT", "IS_SALE")
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]


def clean_query_text(text_or_lines) -> str:
    """Query text from a file's lines, carriage returns removed.

    Lines are joined with a line feed: words at line ends cannot fuse, and a
    ``--`` comment still ends at its line (joining with blanks would let it
    swallow the rest of the query). A trailing ``;`` is dropped.
    """
    lines = text_or_lines.splitlines() if isinstance(text_or_lines, str) else list(text_or_lines)
    text = "\n".join(re.sub(r"[\r\n]", "", ln) for ln in lines).strip()
    return text[:-1].rstrip() if text.endswith(";") else text


def read_sql_file(path: str) -> str:
    with open(path, encoding="utf-8") as fh:
        return clean_query_text(fh.read())


def conform_extract(df: DataFrame, keep=("event_id",)) -> DataFrame:
    """Give an extract the 14 raw columns with their raw types.

    Names match regardless of case. Columns the source lacks are added as nulls
    of the right type (S02); flags delivered as booleans become 1 and 0; columns named in ``keep`` (a tie-break key, say)
    are carried along.
    """
    present = {c.lower(): c for c in df.columns}  # databases differ in name case
    cols = []
    for f in RAW_SCHEMA.fields:
        if f.name.lower() in present:
            source = F.col(f"`{present[f.name.lower()]}`")
            if f.name in FLAGS and isinstance(df.schema[present[f.name.lower()]].dataType, T.BooleanType):
                source = source.cast("int")     # TRUE is 1
            cols.append(source.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    cols += [F.col(f"`{present[k.lower()]}`").alias(k) for k in keep if k.lower() in present]
    return df.select(*cols)


def load_extract_sql(spark: SparkSession, sql_or_path: str, keep=("event_id",)) -> DataFrame:
    """S01 with Spark as the database: run the extract query with ``spark.sql``."""
    text = read_sql_file(sql_or_path) if sql_or_path.endswith(".sql") else clean_query_text(sql_or_path)
    return conform_extract(spark.sql(text), keep)


def load_extract_jdbc(spark: SparkSession, url: str, sql: str, properties: dict | None = None,
                      partition_column: str | None = None, lower_bound=None, upper_bound=None,
                      num_partitions: int | None = None, fetch_size: int = 10_000,
                      keep=("event_id",), one_task: bool = False) -> DataFrame:
    """S01 against a database. With ``partition_column`` the query is read as
    ``num_partitions`` range slices in parallel (the ``query`` option cannot be
    combined with partitioning, so the SQL becomes a derived table). ``properties``
    are the reader's options (user, password, driver). A read in one task has to be
    asked for (``one_task``)."""
    if partition_column and None in (lower_bound, upper_bound, num_partitions):
        raise ValueError("a JDBC partition column needs lower_bound, upper_bound and num_partitions")
    if not partition_column and not one_task:
        raise ValueError("without a partition column the whole extract is read in one task; "
                         "name a partition column, or pass one_task=True for a small extract")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    sql = clean_query_text(sql)
    if partition_column:
        reader = (reader.option("dbtable", f"({sql}) extract_q")
                  .option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    else:
        reader = reader.option("query", sql)
    return conform_extract(reader.load(), keep)


def load_extract_parquet(spark: SparkSession, path: str, keep=("event_id",)) -> DataFrame:
    return conform_extract(spark.read.parquet(path), keep)
