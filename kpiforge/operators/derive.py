"""Projections, derived columns and filters (PRJ1-PRJ16)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.dates import days_between
from kpiforge.functions.numeric import ladder, nullif_zero, recode

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ1."""
    return df.drop(*cols)


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ2."""
    return df.select(*cols)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """PRJ3: ``astype`` for several columns."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def yes_no_to_int(c: ColumnOrName) -> Column:
    """PRJ4: Yes -> 1, No -> 0, anything else -> null."""
    return recode(c, {"Yes": 1, "No": 0})


def total_active_time(training: ColumnOrName, overtime: ColumnOrName, leave: ColumnOrName) -> Column:
    """PRJ5: training + overtime - leave."""
    return _c(training) + _c(overtime) - _c(leave)


def efficiency_rate(units: ColumnOrName, defects: ColumnOrName) -> Column:
    """PRJ6: (units - defects) / units * 100; null for zero units (Q22).

    The production "quality score" is the same formula.
    """
    return (_c(units) - _c(defects)) / nullif_zero(units) * F.lit(100.0)


def delay_days(delivery: ColumnOrName, order: ColumnOrName) -> Column:
    """PRJ7: delivery minus order date in days; negatives kept (Q6)."""
    return days_between(delivery, order)


def description(item: ColumnOrName, supplier: ColumnOrName) -> Column:
    """PRJ9: ``item - supplier``."""
    return F.concat_ws(" - ", _c(item), _c(supplier))


def flag_low_high(df: DataFrame, low_col: str, high_col: str, alias: str = "flag") -> DataFrame:
    """PRJ10 / JN4: ``low_col < mean(low_col) AND high_col > mean(high_col)``.

    Both global means come from one aggregation used as a scalar subquery
    (a struct), not a join, so no row pairs and nothing to broadcast.
    """
    m = df.agg(F.struct(F.avg(low_col).alias("low"), F.avg(high_col).alias("high"))).scalar()
    return df.withColumn(alias, (F.col(low_col) < m["low"]) & (F.col(high_col) > m["high"]))


def recommended_split(df: DataFrame, flag: str) -> DataFrame:
    """PRJ11: number flagged and number not flagged."""
    return df.agg(F.count_if(F.col(flag)).alias("recommended"),
                  (F.count(F.lit(1)) - F.count_if(F.col(flag))).alias("others"))


def where_equals(df: DataFrame, col: str, value) -> DataFrame:
    """PRJ12."""
    return df.where(F.col(col) == F.lit(value))


def scope_to(df: DataFrame, department: str | None, is_admin: bool, col: str = "department") -> DataFrame:
    """PRJ13: admins see every department, others only their own."""
    if is_admin:
        return df
    return df.where(F.col(col) == F.lit(department))


def badge_class(status: ColumnOrName, mapping: Mapping[str, str], default: str) -> Column:
    """PRJ16: status text -> display class."""
    return ladder(status, mapping, default)
