"""Column expressions shared by the document operators (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of the contracts' word pattern [^\x20\x09-\x0D]+.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_RE = r"[\x20\x09-\x0D]+"


def word_count(text) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null and blank texts have 0."""
    trimmed = F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WORD_SPACE))
    return (F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, WORD_SPACE_RE)))
            .otherwise(0).cast("long"))


def utf8(text) -> Column:
    """UTF-8 bytes of a text; null gives none."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def draw(*parts, seed: str) -> Column:
    """A uniform number in (0, 1) that only the parts and the seed decide.

    The top 52 bits of a 64-bit hash, moved by half a step so that 0 and 1 never occur.
    """
    h = F.xxhash64(F.lit(seed), *parts)
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -52)


def spare(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def need(df: DataFrame, *names: str) -> None:
    """Raise where a column that an operator reads is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
