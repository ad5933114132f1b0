"""The difference between two reports of the same shape.

A full outer join of two long tables on their keys, missing keys included, written
as one grouping of both: each row is marked with its side, and a key has at most one
row of each side. That is null-safe without further conditions, moves both tables
once, and a key that one side holds twice fails the job in the same aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame, keys, value: str = "value",
               names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """``keys``, both values under ``names``, ``delta`` (left minus right) and ``status``.

    ``status`` is ``same`` or ``changed`` where both have the key (two missing values are
    the same, and so are two NaN), else ``only <name>``. ``delta`` is missing unless both
    values are there.
    """
    keys = list(keys)

    def side(df, own):
        return df.select(*keys, F.lit(own).alias("_left"), F.col(value).alias("_value"))

    def of(own):
        here = F.col("_left") == own
        twice = F.raise_error(F.concat(F.lit(f"difference: the {names[0 if own else 1]} table has a key twice: "),
                                       F.to_json(F.struct(*keys)))).cast(left.schema[value].dataType)
        return [F.count(F.when(here, 1)).alias(f"_n{int(own)}"),
                F.when(F.count(F.when(here, 1)) > 1, twice).otherwise(F.max(F.when(here, F.col("_value")))).alias(names[0 if own else 1])]

    both = side(left, True).unionByName(side(right, False)).groupBy(*keys).agg(*of(True), *of(False))
    a, b = (F.col(n) for n in names)
    status = (F.when(F.col("_n0") == 0, f"only {names[0]}").when(F.col("_n1") == 0, f"only {names[1]}")
              .when(a.eqNullSafe(b), "same").otherwise("changed"))
    return both.withColumns({"delta": a - b, "status": status}).select(*keys, *names, "delta", "status")
