"""Data dictionary of a table.

``data_dictionary``: one row per column with description, missing count, and
either the range (variable type 0) or the exact number of distinct values (type
1). ``dictionary_values``: the values of the type-1 columns, one row each with
its count; all of them, so a column of many values makes a long table and no
column's values meet in one place. Both are aggregations over one read of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The raw extract's columns in our words.
DESCRIPTIONS = {
    "CASE_ID_T": "case",
    "KLANTNR": "customer",
    "SEGMENT": "model segment",
    "BATCH_TYPE": "batch",
    "CUSTOMER_ATT": "customer attribute",
    "CURRENT_SUB": "current subscription",
    "SUB_START_DATE": "start of the subscription",
    "DATE_OF_BIRTH": "date of birth",
    "CALLPLACEDTIME": "time of the dial attempt",
    "CALLANSWEREDTIME": "time of the answer",
    "LENGTH": "talk time in seconds",
    "ISCONTACT": "whether contact was made",
    "IS_SALE": "whether a sale was made",
    "FINISHCODE": "outcome of the attempt",
}
# Columns described by their values; the others by their range.
VALUE_COLUMNS = ("SEGMENT", "BATCH_TYPE", "CUSTOMER_ATT", "CURRENT_SUB", "ISCONTACT", "IS_SALE", "FINISHCODE")


def _by_column(values, cols, what: str) -> dict:
    """A dict by column name, from a dict or from a list in column order."""
    if values is None:
        return {}
    if isinstance(values, dict):
        return values
    values = list(values)
    if len(values) > len(cols):
        raise ValueError(f"{what}: {len(values)} values for {len(cols)} columns")
    return dict(zip(cols, values))


def dictionary_values(df: DataFrame, columns) -> DataFrame:
    """``variable_name, value, rows`` for every value (null too) of the columns, as text."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable_name"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.*")
    return long.groupBy("variable_name", "value").agg(F.count(F.lit(1)).alias("rows"))


def data_dictionary(df: DataFrame, descriptions=None, var_types=None) -> DataFrame:
    """``descriptions`` / ``var_types``: dicts by column, or lists in column order
    (type 0 = show the range, 1 = show the values, see ``dictionary_values``)."""
    spark = df.sparkSession
    cols = df.columns
    descriptions = _by_column(descriptions, cols, "descriptions")
    var_types = _by_column(var_types, cols, "var_types")
    kinds = {c: int(var_types.get(c, 0)) for c in cols}
    dtypes = dict(df.dtypes)
    shown, ranged = [c for c in cols if kinds[c] == 1], [c for c in cols if kinds[c] != 1]

    # One read: a row becomes one (column, value) for each column shown by its values, and one
    # that carries the columns shown by their range. One aggregation counts the former and
    # takes missing count, min and max of the latter, combined map-side.
    kind = "struct<variable_name:string,value:string,ranged:boolean>"
    parts = [F.struct(F.lit(c).alias("variable_name"), F.col(c).cast("string").alias("value"), F.lit(False).alias("ranged"))
             for c in shown]
    parts.append(F.struct(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True)).cast(kind))
    long = df.select(*ranged, F.explode(F.array(*parts)).alias("kv")).select(*ranged, "kv.*")
    own = [F.when(F.col("ranged"), F.col(c)) for c in ranged]
    groups = long.groupBy("variable_name", "value", "ranged").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[x for i, c in enumerate(own) for x in (F.count(c).alias(f"_k{i}"), F.min(c).cast("string").alias(f"_a{i}"),
                                                 F.max(c).cast("string").alias(f"_z{i}"))])
    # a group is one value of a column, or the row of all ranges
    stat = "struct<variable_name:string,n_missing:bigint,n_distinct:bigint,min:string,max:string>"
    of_value = F.array(F.struct(F.col("variable_name"), F.when(F.col("value").isNull(), F.col("_rows")).otherwise(0),
                                F.lit(1).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")).cast(stat))
    of_range = F.array(*[F.struct(F.lit(c), F.col("_rows") - F.col(f"_k{i}"), F.lit(None).cast("long"),
                                  F.col(f"_a{i}"), F.col(f"_z{i}")).cast(stat) for i, c in enumerate(ranged)])
    each = F.when(F.col("ranged"), of_range if ranged else F.array().cast(f"array<{stat}>")).otherwise(of_value)
    stats = (groups.select(F.explode(each).alias("s")).select("s.*").groupBy("variable_name")
             .agg(F.sum("n_missing").alias("n_missing"), F.sum("n_distinct").alias("n_distinct"),
                  F.max("min").alias("min"), F.max("max").alias("max")))
    meta = spark.createDataFrame([(c, dtypes[c], descriptions.get(c), kinds[c]) for c in cols],
                                 "variable_name string, data_type string, description string, variable_type int")
    return (meta.join(stats, "variable_name", "left")
            .withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))     # a table without rows
            .select("variable_name", "data_type", "description", "variable_type", "n_missing", "n_distinct", "min", "max"))
