"""Sorts and limits (SO1-SO5).

Every limit here is the feature itself (latest N, top N); Spark plans
``orderBy().limit(n)`` as TakeOrderedAndProject (per-task top-n, then a
merge of n rows per task), never a full sort. Ties are always broken by
explicit keys (Q14, Q15) so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recent(df: DataFrame, date_col: ColumnOrName, n: int = 10,
           tie: Sequence[ColumnOrName] = ()) -> DataFrame:
    """Latest ``n`` rows by date, ties by ``tie`` ascending (SO1)."""
    return df.orderBy(_c(date_col).desc(), *[_c(t).asc() for t in tie]).limit(n)


def top_n(df: DataFrame, col: ColumnOrName, n: int = 5,
          tie: Sequence[ColumnOrName] = ()) -> DataFrame:
    """``nlargest(n, col)`` with an explicit tie-break (SO2)."""
    return df.orderBy(_c(col).desc(), *[_c(t).asc() for t in tie]).limit(n)


def last_n(df: DataFrame, order_col: ColumnOrName, n: int = 10) -> DataFrame:
    """``tail(n)``: the ``n`` rows last in ``order_col`` order (SO3).

    A distributed table has no row order, so an order column is mandatory.
    """
    return df.orderBy(_c(order_col).desc()).limit(n)


def top_per_section(grouped: DataFrame, value: str, n: int = 5,
                    key: str = "key", section: str = "section") -> DataFrame:
    """Top ``n`` keys per section by value, adds ``rank`` 1..n (SO4).

    ``row_number() <= n`` lets the optimizer insert a partial
    WindowGroupLimit before the shuffle, so each task ships at most ``n``
    rows per section even when a section has billions of keys.
    """
    w = Window.partitionBy(section).orderBy(F.col(value).desc(), F.col(key).asc())
    return (grouped.withColumn("rank", F.row_number().over(w))
                   .where(F.col("rank") <= n))


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Frame append by column name (SO5)."""
    return df.unionByName(extra)
