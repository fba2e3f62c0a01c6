"""What-if projection (WI1-WI4, JN1, FN13-FN14).

The reference computes these in the browser from constants. Here a
scenario is a row (department, metric, pct); the current value comes from
a KPI table computed from data, falling back to the reference's base
values; the knock-on multipliers and impact vectors are a fixed 24-row
dimension joined by (department, metric) with broadcast (its size is fixed
by construction). Unknown departments use the ``it`` rows; unknown metrics
use the fallback row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions.numeric import signed_pct

# Fixed values of the reference: (department, metric, first multiplier,
# first effect, second multiplier, second effect, six impacts).
COEFFICIENTS = [
    ("it", "delivery_time", 0.8, "user satisfaction", 0.6, "system performance", [15, -8, 12, -10, 20, 14]),
    ("it", "cost", 0.3, "reliability", 0.4, "efficiency", [-12, -15, 8, -10, 6, -8]),
    ("it", "efficiency", 0.7, "manual tasks", 0.9, "productivity", [20, -10, 25, 15, 18, 22]),
    ("hr", "satisfaction", 0.6, "retention", 0.5, "productivity", [18, 12, -8, 15, 10, 14]),
    ("hr", "cost", 0.3, "service quality", 0.4, "efficiency", [-10, -15, 6, -12, 4, -8]),
    ("hr", "productivity", 0.8, "output", 0.6, "quality", [22, 15, -10, 18, 12, 16]),
    ("finance", "revenue", 0.4, "margin", 0.3, "market share", [25, 18, -12, 20, 15, 22]),
    ("finance", "cost", 0.8, "margin", 0.5, "efficiency", [-15, -20, 10, -18, 8, -12]),
    ("finance", "efficiency", 0.7, "processing time", 0.6, "accuracy", [20, -12, 28, 18, 15, 20]),
    ("marketing", "revenue", 0.7, "sales", 0.5, "brand awareness", [22, 15, -10, 18, 12, 16]),
    ("marketing", "satisfaction", 0.6, "loyalty", 0.4, "referrals", [20, 14, -8, 16, 10, 14]),
    ("marketing", "efficiency", 0.5, "campaign cost", 0.3, "conversion", [18, -10, 24, 16, 12, 18]),
    ("sales", "revenue", 0.4, "market share", 0.6, "profit", [24, 16, -12, 20, 14, 18]),
    ("sales", "efficiency", 0.7, "conversion", 0.5, "acquisition", [20, -10, 26, 18, 14, 20]),
    ("sales", "satisfaction", 0.8, "repeat business", 0.6, "lifetime value", [22, 15, -8, 18, 12, 16]),
    ("production", "efficiency", 0.6, "cost", 0.4, "quality", [20, -12, 25, 18, 15, 20]),
    ("production", "cost", 0.3, "quality", 0.5, "efficiency", [-15, -18, 10, -15, 8, -10]),
    ("production", "quality", 0.7, "defects", 0.5, "satisfaction", [18, 12, -8, 15, 10, 14]),
    ("transport", "delivery_time", 0.8, "satisfaction", 0.4, "operating cost", [20, -10, 15, -12, 18, 14]),
    ("transport", "cost", 0.3, "service quality", 0.5, "efficiency", [-12, -15, 8, -10, 6, -8]),
    ("transport", "efficiency", 0.6, "operating cost", 0.4, "delivery time", [18, -8, 22, 16, 12, 18]),
    ("supply_chain", "efficiency", 0.7, "cost", 0.5, "delivery time", [22, -10, 20, 15, 18, 20]),
    ("supply_chain", "cost", 0.3, "service level", 0.5, "efficiency", [-15, -18, 10, -12, 8, -10]),
    ("supply_chain", "inventory", 0.6, "holding cost", 0.4, "cash flow", [18, -12, 20, 15, 12, 16]),
]
FALLBACK_IMPACTS = [10, 8, -5, -12, 7, 5]
IMPACT_LABELS = ["Customer Satisfaction", "Operational Cost", "Process Efficiency",
                 "Revenue Impact", "Employee Productivity", "Service Quality"]
# metric -> (base value, unit); any other metric: (100, "")
BASE_VALUES = {
    "delivery_time": (2.5, "h"),
    "cost": (1200.0, "$"),
    "efficiency": (85.0, "%"),
    "satisfaction": (4.2, ""),
    "revenue": (50000.0, "$"),
    "productivity": (92.0, "%"),
}
DEFAULT_BASE = (100.0, "")
FALLBACK_DEPARTMENT = "it"

COEF_SCHEMA = ("department string, metric string, m1 double, effect1 string, m2 double, "
               "effect2 string, impacts array<int>")
BASE_SCHEMA = "metric string, base_value double, unit string"


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COEFFICIENTS, COEF_SCHEMA)


def base_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, v, u) for m, (v, u) in BASE_VALUES.items()], BASE_SCHEMA)


def project(scenarios: DataFrame, kpis: DataFrame | None = None) -> DataFrame:
    """WI1, WI2, WI4: scenarios (department, metric, pct) -> projections.

    ``kpis`` (department, metric, current) supplies data-derived current
    values; scenarios without one use the metric's base value.
    Output: department, metric, pct, current, projected, unit,
    projected_text, effect1, effect1_pct, effect2, effect2_pct, direction,
    change_text.
    """
    spark = scenarios.sparkSession
    coef = coefficients(spark)
    # JN1: unknown department -> the fallback department's rows
    known = coef.select("department").distinct()
    s = (scenarios.join(F.broadcast(known.withColumn("_known", F.lit(True))), "department", "left")
         .withColumn("lookup_department",
                     F.when(F.col("_known"), F.col("department"))
                      .otherwise(F.lit(FALLBACK_DEPARTMENT)))
         .drop("_known"))
    c = coef.withColumnRenamed("department", "lookup_department").drop("impacts")
    s = s.join(F.broadcast(c), ["lookup_department", "metric"], "left")
    s = s.join(F.broadcast(base_values(spark)), "metric", "left")
    if kpis is not None:
        s = s.join(kpis.select("department", "metric", F.col("current").alias("_kpi")),
                   ["department", "metric"], "left")
    else:
        s = s.withColumn("_kpi", F.lit(None).cast("double"))
    pct = F.col("pct")
    current = F.coalesce(F.col("_kpi"), F.col("base_value"), F.lit(DEFAULT_BASE[0]))
    unit = F.coalesce(F.col("unit"), F.lit(DEFAULT_BASE[1]))
    moves = F.when(pct >= 0, "increase").otherwise("decrease")
    projected = current * (F.lit(1.0) + pct / F.lit(100.0))
    return s.select(
        "department", "metric", pct.alias("pct"),
        current.alias("current"),
        projected.alias("projected"),
        unit.alias("unit"),
        F.concat(unit, F.format_string("%.1f", projected)).alias("projected_text"),
        "effect1", F.round(F.abs(pct * F.col("m1")), 6).alias("effect1_pct"),
        F.when(F.col("m1").isNotNull(), moves).alias("effect1_direction"),
        "effect2", F.round(F.abs(pct * F.col("m2")), 6).alias("effect2_pct"),
        F.when(F.col("m2").isNotNull(), moves).alias("effect2_direction"),
        F.when(pct >= 0, "positive").otherwise("negative").alias("direction"),
        signed_pct(pct).alias("change_text"))


def impacts(scenarios: DataFrame) -> DataFrame:
    """WI3: six labelled impacts per scenario (``current`` is carried along if given)."""
    spark = scenarios.sparkSession
    coef = coefficients(spark).select("department", "metric", "impacts")
    fallback = F.array(*[F.lit(v) for v in FALLBACK_IMPACTS])
    known = coefficients(spark).select("department").distinct().withColumn("_known", F.lit(True))
    s = (scenarios.join(F.broadcast(known), "department", "left")
         .withColumn("lookup_department",
                     F.when(F.col("_known"), F.col("department"))
                      .otherwise(F.lit(FALLBACK_DEPARTMENT))))
    s = s.join(F.broadcast(coef.withColumnRenamed("department", "lookup_department")),
               ["lookup_department", "metric"], "left")
    labels = F.array(*[F.lit(x) for x in IMPACT_LABELS])
    vec = F.coalesce(F.col("impacts"), fallback)
    keep = [c for c in ("pct", "current") if c in scenarios.columns]
    return (s.select("department", "metric", *keep,
                     F.posexplode(F.arrays_zip(labels.alias("label"), vec.alias("impact"))))
             .select("department", "metric", *keep, (F.col("pos") + 1).alias("idx"),
                     F.col("col.label").alias("impact_label"),
                     F.col("col.impact").alias("impact")))


def scenario_grid(kpis: DataFrame, pcts: Sequence[float]) -> DataFrame:
    """Every (department, metric) of ``kpis`` crossed with a pct list (explode, no join)."""
    if any(not -100 <= p <= 100 for p in pcts):
        raise ValueError("percentages lie between -100 and 100")
    grid = F.array(*[F.lit(float(p)) for p in pcts])
    return kpis.select("department", "metric", F.explode(grid).alias("pct"))
