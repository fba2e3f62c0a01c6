"""Production operations pack (PR1-PR6, PRJ6).

Roles: production_id, product, units, defects, line, shift, utilization,
date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import fmt_date, month_bucket
from kpiforge.operators.aggregate import arg_max
from kpiforge.operators.derive import efficiency_rate
from kpiforge.plans.common import MEAN_DIGITS, numbered, rmean


def _eff():
    return efficiency_rate("units", "defects")


def _efficiency_sums() -> dict:
    return {"eff": F.sum(_eff()), "n": F.count(_eff())}


def metrics(src) -> DataFrame:
    """PR1: operations, mean efficiency, mean quality, mean machine utilisation.

    Efficiency and quality are one formula (Q22); both are reported.
    """
    df = src.frame("units", "defects", "utilization")
    return df.agg(F.count(F.lit(1)).alias("total_operations"),
                  rmean(_eff()).alias("avg_efficiency"),
                  rmean(_eff()).alias("avg_quality_score"),
                  rmean("utilization").alias("avg_machine_utilization"))


def distributions(src) -> DataFrame:
    """PR2: operation counts by product, line and shift."""
    return src.keyed_sums({"product_lines": "product", "production_lines": "line", "shifts": "shift"},
                          {"n": F.count(F.lit(1))}, [])


def monthly_trends(src) -> DataFrame:
    """PR3: mean efficiency by month of year."""
    df = src.frame("date", "units", "defects")
    return (df.where(F.col("date").isNotNull())
              .groupBy(month_bucket("date", "month_of_year").alias("month"))
              .agg(rmean(_eff()).alias("avg_efficiency")))


def performance(src) -> DataFrame:
    """PR4: mean efficiency by product, line and shift."""
    sums = src.keyed_sums({"by_product": "product", "by_line": "line", "by_shift": "shift"}, _efficiency_sums(),
                          ["units", "defects"])
    return sums.select("section", "key", F.round(F.try_divide("eff", "n"), MEAN_DIGITS).alias("avg_efficiency"))


def recent_operations(src, n: int = 10) -> DataFrame:
    """PR5: latest operations, date ``YYYY-MM-DD``; ties broken on every column."""
    top = src.latest("date", n, ["production_id", "date", "product", "line", "shift", "units", "defects"],
                     ties=["production_id", "product", "line", "shift", "units", F.round("defects", MEAN_DIGITS)],
                     keys=["production_id"])
    shaped = top.select("date", "production_id", "product", "line", "shift", "units",
                       F.round("defects", MEAN_DIGITS).alias("defects"),
                       F.round(_eff(), MEAN_DIGITS).alias("efficiency_rate"),
                       F.round(_eff(), MEAN_DIGITS).alias("quality_score"))
    return shaped.withColumn("date", fmt_date("date"))


def insights(src) -> DataFrame:
    """PR6: four insight strings -> (idx, insight)."""
    by_product = src.keyed_sums({"product": "product"}, _efficiency_sums(), ["units", "defects"])
    best = arg_max(by_product.select("key", F.try_divide("eff", "n").alias("m")), "key", "m").select("key")
    base = src.frame("units", "defects", "utilization").agg(F.avg(_eff()).alias("e"), F.avg("utilization").alias("u"))
    return numbered(base, [
        F.format_string("Average efficiency rate is %.1f%%", F.bround("e", 1)),
        F.format_string("Average quality score is %.1f%%", F.bround("e", 1)),
        F.format_string("Average machine utilization is %.1f%%", F.bround("u", 1)),
        F.concat(F.lit("Most efficient product is "), best.scalar()),
    ])
