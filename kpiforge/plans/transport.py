"""Transport and logistics pack (TR1-TR6).

Roles: employee_id, role, entry_date, deliveries, delivery_time, vehicle,
condition, fuel, maintenance, on_time_rate, incidents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import month_bucket
from kpiforge.operators.aggregate import value_counts_multi
from kpiforge.plans.common import rmean


def metrics(src) -> DataFrame:
    """TR1: deliveries, mean delivery time (r1), mean on-time rate (r1), incidents."""
    df = src.frame("deliveries", "delivery_time", "on_time_rate", "incidents")
    return df.agg(F.sum("deliveries").cast("long").alias("total_deliveries"),
                  F.round(F.avg("delivery_time"), 1).alias("avg_delivery_time"),
                  F.round(F.avg("on_time_rate"), 1).alias("avg_on_time_rate"),
                  F.sum("incidents").cast("long").alias("total_incidents"))


def distributions(src) -> DataFrame:
    """TR2: counts by vehicle type and by role."""
    df = src.frame("vehicle", "role")
    return value_counts_multi(df, {"vehicle_types": "vehicle", "roles": "role"})


def by_vehicle(src) -> DataFrame:
    """TR3: mean delivery time by vehicle type."""
    df = src.frame("vehicle", "delivery_time")
    return (df.where(F.col("vehicle").isNotNull()).groupBy("vehicle")
              .agg(rmean("delivery_time").alias("avg_delivery_time")))


def monthly_deliveries(src) -> DataFrame:
    """TR4: deliveries by ``yyyy-MM`` of entry date."""
    df = src.frame("entry_date", "deliveries")
    return (df.where(F.col("entry_date").isNotNull())
              .groupBy(month_bucket("entry_date", "year_month").alias("month"))
              .agg(F.sum("deliveries").cast("long").alias("deliveries")))


def insights(src) -> DataFrame:
    """TR5: three insight records (title, description, impact, trend)."""
    m = metrics(src)
    rows = [
        ("Vehicle Performance",
         F.format_string("Average delivery time is %.1f hours with %.1f%% on-time rate.",
                         "avg_delivery_time", "avg_on_time_rate"), "High", "Improving"),
        ("Incident Analysis",
         F.format_string("Total incidents reported: %d. Focus on preventive maintenance.",
                         "total_incidents"), "Medium", "Stable"),
        ("Fleet Utilization",
         F.lit("Analyze vehicle type distribution for optimal resource allocation."),
         "High", "Increasing"),
    ]
    structs = [F.struct(F.lit(i + 1).alias("idx"), F.lit(t).alias("title"),
                        d.alias("description"), F.lit(imp).alias("impact"),
                        F.lit(tr).alias("trend"))
               for i, (t, d, imp, tr) in enumerate(rows)]
    return m.select(F.inline(F.array(*structs)))


def monthly_service(src) -> DataFrame:
    """TR6: mean delivery time and mean on-time rate by ``yyyy-MM``."""
    df = src.frame("entry_date", "delivery_time", "on_time_rate")
    return (df.where(F.col("entry_date").isNotNull())
              .groupBy(month_bucket("entry_date", "year_month").alias("month"))
              .agg(rmean("delivery_time").alias("avg_delivery_time"),
                   rmean("on_time_rate").alias("avg_on_time_rate")))
