"""IT support pack (IT1-IT6).

Roles: ticket_id, system, issue, reported_at, hours, status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import fmt_datetime, month_bucket, rate
from kpiforge.operators.aggregate import group_agg_multi, value_counts, value_counts_multi
from kpiforge.operators.topk import recent
from kpiforge.plans.common import MEAN_DIGITS, numbered, rmean

# Fixed values of the reference.
SYSTEM_UPTIME = 99.9


def metrics(src) -> DataFrame:
    """IT1: tickets, mean resolution hours, % resolved within an hour, uptime."""
    df = src.frame("hours")
    return df.agg(F.count(F.lit(1)).alias("total_tickets"),
                  rmean("hours").alias("avg_resolution_time"),
                  F.round(rate(F.col("hours") <= 1), MEAN_DIGITS).alias("first_call_resolution"),
                  F.lit(SYSTEM_UPTIME).alias("system_uptime"))


def distributions(src) -> DataFrame:
    """IT2: ticket counts by issue, system and status -> (section, key, n)."""
    df = src.frame("issue", "system", "status")
    return value_counts_multi(df, {"ticket_types": "issue", "systems": "system",
                                   "status": "status"})


def monthly_trends(src) -> DataFrame:
    """IT3: mean resolution hours by month of year (1..12, years merged)."""
    df = src.frame("reported_at", "hours")
    return (df.where(F.col("reported_at").isNotNull())
              .groupBy(month_bucket("reported_at", "month_of_year").alias("month"))
              .agg(rmean("hours").alias("avg_resolution_time")))


def performance(src) -> DataFrame:
    """IT4: mean resolution hours by system and by issue."""
    df = src.frame("system", "issue", "hours")
    return group_agg_multi(df, {"by_system": "system", "by_issue": "issue"},
                           {"avg_resolution_time": rmean("hours")}, keep=["hours"])


def recent_tickets(src, n: int = 10) -> DataFrame:
    """IT5: latest tickets, date as ``YYYY-MM-DD HH:MM:SS``; ties by ticket id."""
    df = src.frame("ticket_id", "system", "issue", "reported_at", "hours", "status")
    top = recent(df, "reported_at", n, tie=["ticket_id"])
    return top.select("ticket_id", "system", "issue",
                      fmt_datetime("reported_at").alias("reported_date"),
                      F.col("hours").cast("double").alias("hours"), "status")


def insights(src) -> DataFrame:
    """IT6: three insight strings -> (idx, insight)."""
    df = src.frame("issue", "hours")
    top_issue = (value_counts(df, "issue")
                 .orderBy(F.desc("n"), F.asc("key")).limit(1).select("key"))
    base = df.agg(F.avg("hours").alias("avg"), rate(F.col("hours") <= 1).alias("fcr"))
    return numbered(base, [
        F.format_string("Average resolution time is %.1f hours", F.bround("avg", 1)),
        F.format_string("First call resolution rate is %.1f%%", F.bround("fcr", 1)),
        F.concat(F.lit("Most common issue is "), top_issue.scalar()),
    ])
