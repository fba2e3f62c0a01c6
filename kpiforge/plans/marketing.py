"""Marketing campaign pack (MK1-MK3).

The reference's routes read these keys but nothing produces them; the
formulas are ours. Roles: campaign_id, campaign_type, channel, start_date,
end_date, budget, leads, conversion_rate, revenue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import fmt_date
from kpiforge.operators.aggregate import group_agg_multi
from kpiforge.operators.topk import recent
from kpiforge.plans.common import MEAN_DIGITS, SUM_DIGITS, rmean, rsum


def _roi(rev, budget):
    return (rev - budget) / budget * F.lit(100.0)


def metrics(src) -> DataFrame:
    """MK1: campaigns, mean conversion rate, acquisition cost, ROI."""
    df = src.frame("budget", "leads", "conversion_rate", "revenue")
    budget = F.sum("budget")
    conversions = F.sum(F.col("leads") * F.col("conversion_rate") / F.lit(100.0))
    return df.agg(F.count(F.lit(1)).alias("total_campaigns"),
                  rmean("conversion_rate").alias("conversion_rate"),
                  F.round(budget / conversions, MEAN_DIGITS).alias("acquisition_cost"),
                  F.round(_roi(F.sum("revenue"), budget), MEAN_DIGITS).alias("roi"))


def performance(src) -> DataFrame:
    """MK2: budget, leads, revenue and ROI by campaign type and by channel."""
    df = src.frame("campaign_type", "channel", "budget", "leads", "revenue")
    return group_agg_multi(
        df, {"campaign_performance": "campaign_type", "channel_effectiveness": "channel"},
        {"budget": rsum("budget"), "leads": F.sum("leads").cast("long"),
         "revenue": rsum("revenue"),
         "roi": F.round(_roi(F.sum("revenue"), F.sum("budget")), MEAN_DIGITS)},
        keep=["budget", "leads", "revenue"])


def recent_campaigns(src, n: int = 10) -> DataFrame:
    """MK3: latest campaigns by start date (ties by id), two decimals."""
    df = src.frame("campaign_id", "campaign_type", "channel", "start_date", "budget", "leads",
                   "conversion_rate", "revenue")
    top = recent(df, "start_date", n, tie=["campaign_id"])
    return top.select("campaign_id", "campaign_type", "channel",
                      fmt_date("start_date").alias("start_date"),
                      F.round("budget", SUM_DIGITS).alias("budget"), "leads",
                      F.round("conversion_rate", SUM_DIGITS).alias("conversion_rate"),
                      F.round("revenue", SUM_DIGITS).alias("revenue"))
