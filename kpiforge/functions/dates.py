"""Date helpers (FN1-FN6, FN15, PRJ7, PRJ15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_bucket(c: ColumnOrName, grain: str = "year_month") -> Column:
    """Time bucket for trends (Q10).

    ``month_of_year`` -> int 1..12 (years merged, as the IT/production
    trends do); ``year_month`` -> ``'yyyy-MM'`` text (supply, sales,
    transport).
    """
    if grain == "month_of_year":
        return F.month(_c(c))
    if grain == "year_month":
        return F.date_format(_c(c), "yyyy-MM")
    raise ValueError(f"unknown grain {grain!r}")


def weekday_mon0(c: ColumnOrName) -> Column:
    """Day of week with Monday = 0 (FN3, Q11)."""
    return F.weekday(_c(c))


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Whole days from ``start`` to ``end``; negative when end precedes start (FN6, Q6)."""
    return F.datediff(_c(end), _c(start))


def parse_dmy(c: ColumnOrName) -> Column:
    """``dd/MM/yyyy`` text -> date (HR hire date)."""
    return F.to_date(_c(c), "dd/MM/yyyy")


def days_since(c: ColumnOrName, as_of: str) -> Column:
    """Days from a date to a fixed as-of date (PRJ15)."""
    return F.datediff(F.lit(as_of).cast("date"), _c(c))


def fmt_date(c: ColumnOrName) -> Column:
    """``YYYY-MM-DD`` (FN4)."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def fmt_datetime(c: ColumnOrName) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` (FN4, IT recent tickets)."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def iso_or_null(c: ColumnOrName) -> Column:
    """ISO-8601 text of a nullable timestamp; null stays null (FN15)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss")
