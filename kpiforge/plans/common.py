"""Shared conventions for the packs.

Means are rounded to ``MEAN_DIGITS`` and float sums to ``SUM_DIGITS`` in
the long-form outputs: floating-point sums are order dependent and a
distributed sum has no fixed order, so rounding makes results stable
across partitionings (and comparable with other engines). Sections whose
reference output is already rounded keep the reference's digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEAN_DIGITS = 6
SUM_DIGITS = 2


def rmean(c: Column | str) -> Column:
    return F.round(F.avg(c), MEAN_DIGITS)


def rsum(c: Column | str) -> Column:
    return F.round(F.sum(c), SUM_DIGITS)


def numbered(df: DataFrame, texts: list[Column], alias: str = "insight") -> DataFrame:
    """One row per text, numbered 1..n (``idx``), from a one-row frame."""
    rows = [F.struct(F.lit(i + 1).alias("idx"), t.alias(alias)) for i, t in enumerate(texts)]
    return df.select(F.inline(F.array(*rows)))
