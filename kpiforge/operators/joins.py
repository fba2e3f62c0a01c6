"""Join operators (JN3; JN1 is in ``whatif``, JN4 a scalar subquery where it is used).

Only tables whose size is bounded by construction are broadcast: code-
defined dimensions (coefficients, defaults) and the TPC-H nation/region
tables (25 / 5 rows by specification). Everything else is joined with a
plain ``join`` so Catalyst and AQE choose the strategy from actual sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def logs_with_users(logs: DataFrame, users: DataFrame, log_key: str = "user_id",
                    user_key: str = "id") -> DataFrame:
    """JN3: audit/manifest rows with their user (left equi-join)."""
    return logs.join(users, logs[log_key] == users[user_key], "left")
