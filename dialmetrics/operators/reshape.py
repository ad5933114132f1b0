"""Long and wide reshapes.

``to_wide`` takes the list of key values: the output schema is then fixed and no
extra job has to find the distinct keys (or ``None``: the values present, as
``spread`` does). It is written as one conditional
aggregation per value, a single ``groupBy`` with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S


def to_long(df: DataFrame, value_cols, key: str = "key", value: str = "value") -> DataFrame:
    """G01 (``gather``): the named columns become (key, value) rows; nulls kept."""
    ids = [c for c in df.columns if c not in value_cols]
    return df.unpivot(ids, list(value_cols), key, value)


def to_wide(df: DataFrame, key: str, value: str, values, names=None,
            check_unique: bool = True, others: str = "raise") -> DataFrame:
    """G02 (``spread``): one column per key value, other columns are row keys.

    ``values`` are the key values to turn into columns, in output order; cells
    without a row stay null. ``values=None`` takes the values present in the
    data, as ``spread`` does (one small extra job; the schema then follows the data).
    A key value outside a given list fails the job (``others="raise"``), so that no
    cell is lost unseen; ``others="drop"`` leaves such rows out. ``names`` renames the new
    columns (R02). A cell fed by two rows fails the job, as in ``spread`` (G03): each cell
    counts its rows in the aggregation that fills it (``check_unique=False``: the larger value).
    """
    rest = [c for c in df.columns if c not in (key, value)]
    if values is None:
        values = present_values(df, key)
    elif others == "raise":
        kind = df.schema[key].dataType
        known = F.col(key).isNull() | F.col(key).isin(*values) if values else F.col(key).isNull()
        stray = F.concat(F.lit(f"to_wide: {key} has a value outside the list: "), F.col(key).cast("string"))
        df = df.withColumn(key, F.when(known, F.col(key)).otherwise(F.raise_error(stray).cast(kind)))
    names = list(names) if names is not None else [str(v) for v in values]
    kind = df.schema[value].dataType

    def cell(v):
        here = F.col(key) == F.lit(v)
        most = F.max(F.when(here, F.col(value)))
        if not check_unique:
            return most
        twice = F.raise_error(F.lit(f"to_wide: several rows share one cell of {key} = {v}")).cast(kind)
        return F.when(F.count(F.when(here, 1)) > 1, twice).otherwise(most)

    if not values:      # only the row keys remain
        return df.select(*rest).distinct()
    return df.groupBy(*rest).agg(*[cell(v).alias(n) for v, n in zip(values, names)])


def to_wide_coded(df: DataFrame, key: str, value: str, values, names, codes) -> DataFrame:
    """``to_wide`` for a text value drawn from a known list ``codes``.

    The text is replaced by its 1-based position in ``codes`` before the pivot
    and put back after it: ``max`` over a number is a hash aggregation, while
    ``max`` over text needs a sort-based one. A text not in ``codes`` raises no
    error but comes back null, so only use it where the list is complete.
    """
    arr = F.array(*[F.lit(c) for c in codes])
    coded = df.withColumn(value, F.array_position(arr, F.col(value)).cast("int"))
    wide = to_wide(coded, key, value, values, names)
    return wide.withColumns({
        n: F.when(F.col(n) > 0, F.element_at(arr, F.col(n))) for n in names})


def present_values(df: DataFrame, key: str) -> list:
    """The non-null values of ``key`` in ``df``, sorted by the column's type
    (text keys in text order). Meant for aggregated inputs, where the count is
    bounded by the key's cardinality (weeks, hours, attempt numbers); this is
    the same small job Spark's own ``pivot`` runs when given no values."""
    return [r[0] for r in df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).collect()]


def sequence_text(cols, sep: str = ", "):
    """The cells of a wide row as one text, missing cells written ``NA``."""
    return S.paste_na(cols, sep)
