"""Numeric helpers (AG3, AG8, PRJ4, PRJ16, FN9-FN10, FN13-FN14)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(cond: Column) -> Column:
    """Share of rows (in %) where ``cond`` holds.

    A null comparison counts as False but stays in the denominator (Q13),
    which is what ``(s <= 1).mean() * 100`` does in pandas.
    """
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * F.lit(100.0)


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` if ``den > 0`` else ``default`` (AG8)."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def nullif_zero(c: ColumnOrName) -> Column:
    """Null instead of zero, so a division yields null, not inf/NaN (Q22)."""
    c = _c(c)
    return F.when(c != 0, c)


def recode(c: ColumnOrName, mapping: Mapping[Any, Any]) -> Column:
    """Map values through a dict; unmapped values become null (PRJ4)."""
    c = _c(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out if out is not None else F.lit(None)


def ladder(c: ColumnOrName, mapping: Mapping[Any, Any], default: Any) -> Column:
    """Equality ladder with a default, e.g. status -> badge class (PRJ16)."""
    c = _c(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return (out.otherwise(F.lit(default))) if out is not None else F.lit(default)


def parse_number(c: ColumnOrName) -> Column:
    """Strip everything but digits, sign and point, then parse (FN13)."""
    return F.regexp_replace(_c(c), r"[^0-9.\-]", "").cast("double")


def signed_pct(c: ColumnOrName) -> Column:
    """``+12.5%`` / ``-3.0%`` / ``0.0%`` text (FN14, WI4)."""
    c = _c(c)
    return F.when(c > 0, F.format_string("+%.1f%%", c)).otherwise(F.format_string("%.1f%%", c))
