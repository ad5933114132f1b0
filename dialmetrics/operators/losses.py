"""Texts that typing lost (V7, V8): R warns where a value does not parse, Spark gives null.

``lost_mask`` marks on each row which of its texts became null, one bit for each typed
column. ``loss_report`` counts them over a table. A writer that lands the typed rows
anyway counts them on the way (``observed``), without another scan: the metrics sit above
the write's shuffle, in the stage that writes, so each row counts once even where the
stages before run again (a range partitioning samples its input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import semantics as S

LOST = "_lost"
# Typed column -> raw text column and its parser. The birth date stays text in the
# attempts (F03 is off by default); its parser is counted all the same.
PARSERS = {
    "sub_start_date": ("SUB_START_DATE", S.parse_date),
    "placed_time": ("CALLPLACEDTIME", S.parse_timestamp),
    "answered_time": ("CALLANSWEREDTIME", S.parse_timestamp),
    "is_contact": ("ISCONTACT", S.to_int),
    "is_sale": ("IS_SALE", S.to_int),
    "date_of_birth": ("DATE_OF_BIRTH", S.parse_dmy),
}


def lost_mask() -> Column:
    """Over a raw extract: bit ``2i`` where the text of column ``i`` is there, bit ``2i + 1`` where it is lost."""
    bits = F.lit(0)
    for i, (raw, parse) in enumerate(PARSERS.values()):
        there = F.col(raw).isNotNull()
        bits = bits + F.when(there & parse(raw).isNull(), 3 << 2 * i).when(there, 1 << 2 * i).otherwise(0)
    return bits.cast("int")


def _counts() -> list[Column]:
    def of(bit: int) -> Column:
        return F.coalesce(F.sum(F.col(LOST).bitwiseAND(F.lit(1 << bit)) / F.lit(1 << bit)), F.lit(0)).cast("long")

    return [of(2 * i + j).alias(f"{what}_{name}") for i, name in enumerate(PARSERS) for j, what in enumerate(("texts", "lost"))]


def loss_report(raw: DataFrame) -> DataFrame:
    """``variable_name, texts, lost`` of a raw extract, in one aggregation."""
    wide = raw.select(lost_mask().alias(LOST)).agg(*_counts())
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable_name"), F.col(f"texts_{n}").alias("texts"), F.col(f"lost_{n}").alias("lost"))
        for n in PARSERS])).alias("r")).select("r.*")


def observed(df: DataFrame, observation: Observation) -> DataFrame:
    """``df`` without its mask; the counts are in ``observation`` once the rows are written."""
    return df.observe(observation, *_counts()).drop(LOST)


def losses_of(observation: Observation) -> dict[str, tuple[int, int]]:
    """(texts, lost) by column, after the write. A write of no rows may report nothing."""
    got = observation.get
    return {n: (int(got.get(f"texts_{n}") or 0), int(got.get(f"lost_{n}") or 0)) for n in PARSERS}
