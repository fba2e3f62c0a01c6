"""Text helpers (FN8, FN11, FN12).

Fixed-decimal formats round half-to-even on the value first (``bround``):
Python's ``format`` (and C ``printf``) resolve exact ties that way, while
Java's formatter rounds them up (``8.25`` -> ``8.2`` vs ``8.3``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt1(c: ColumnOrName) -> Column:
    """``{:.1f}``."""
    return F.format_string("%.1f", F.bround(_c(c), 1))


def fmt2(c: ColumnOrName) -> Column:
    """``{:.2f}``."""
    return F.format_string("%.2f", F.bround(_c(c), 2))


def money(c: ColumnOrName) -> Column:
    """``${:,.2f}``."""
    return F.format_string("$%,.2f", F.bround(_c(c), 2))


def safe_name(c: ColumnOrName) -> Column:
    """Lower-case, drop parentheses, spaces and slashes -> ``_`` (FN11)."""
    lowered = F.lower(_c(c))
    return F.regexp_replace(F.regexp_replace(lowered, r"[()]", ""), r"[ /]", "_")


def file_extension(c: ColumnOrName) -> Column:
    """Lower-cased text after the last dot; null when there is no dot (FN12)."""
    c = _c(c)
    return F.when(F.instr(c, ".") > 0, F.lower(F.substring_index(c, ".", -1)))
