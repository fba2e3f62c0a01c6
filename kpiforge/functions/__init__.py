"""Column-level helpers; every one returns a JVM-side ``Column`` (no UDFs)."""

from kpiforge.functions.dates import (  # noqa: F401
    days_between, days_since, fmt_date, fmt_datetime, iso_or_null, month_bucket,
    parse_dmy, weekday_mon0,
)
from kpiforge.functions.numeric import (  # noqa: F401
    ladder, nullif_zero, parse_number, rate, recode, safe_ratio, signed_pct,
)
from kpiforge.functions.text import file_extension, fmt1, fmt2, money, safe_name  # noqa: F401
