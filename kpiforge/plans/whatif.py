"""What-if scenarios over data-derived KPIs (WI1-WI4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions import rate
from kpiforge.operators import whatif
from kpiforge.operators.derive import delay_days, efficiency_rate
from kpiforge.sources import testbed
from kpiforge.sources.tables import Tables

DEFAULT_PCTS = (-20.0, -10.0, 0.0, 10.0, 20.0)
#: What ``current_kpis`` supplies; the scenarios take it from here, not from a scan.
KPI_PAIRS = (("it", "delivery_time"), ("it", "efficiency"), ("production", "efficiency"),
             ("production", "quality"), ("supply_chain", "cost"), ("supply_chain", "efficiency"),
             ("transport", "delivery_time"), ("transport", "efficiency"), ("sales", "revenue"),
             ("sales", "discount"), ("warehouse", "cost"), ("hr", "productivity"), ("marketing", "revenue"))


def _rows(df: DataFrame, department: str, **metrics) -> DataFrame:
    """One aggregation over ``df`` -> one (department, metric, current) row per metric."""
    wide = df.agg(*[v.alias(k) for k, v in metrics.items()])
    return (wide.unpivot([], list(metrics), "metric", "current")
                .select(F.lit(department).alias("department"), "metric", "current"))


def current_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(department, metric, current) for the what-if metrics the data can supply.

    One aggregation per department frame. Means are rounded to 6 digits and
    sums to 2, so projections are stable under any partitioning.
    """
    it = testbed.it_support(spark, sf_dir).frame("hours")
    pr = testbed.production(spark, sf_dir).frame("units", "defects")
    sc = testbed.supply_chain(spark, sf_dir).frame("order_date", "delivery_date", "total_cost")
    sa = testbed.sales(spark, sf_dir).frame("revenue")
    li = Tables(spark, sf_dir)("lineitem")
    tr = testbed.transport(spark, sf_dir).frame("delivery_time", "on_time_rate")
    hr = testbed.hr(spark, sf_dir).frame("performance")
    mk = testbed.marketing(spark, sf_dir).frame("revenue")
    r6 = lambda c: F.round(c, 6)
    eff = r6(F.avg(efficiency_rate("units", "defects")))
    parts = [
        _rows(it, "it", delivery_time=r6(F.avg("hours")),
              efficiency=r6(rate(F.col("hours") <= 1))),
        _rows(pr, "production", efficiency=eff, quality=eff),
        _rows(sc, "supply_chain", cost=F.round(F.sum("total_cost") / F.count(F.lit(1)), 2),
              efficiency=r6(rate(delay_days("delivery_date", "order_date") <= 0))),
        _rows(tr, "transport", delivery_time=r6(F.avg("delivery_time")),
              efficiency=r6(F.avg("on_time_rate"))),
        _rows(sa, "sales", revenue=F.round(F.sum("revenue"), 2)),
        # a metric and a department without coefficients: the lookups' fallbacks (JN1)
        _rows(li, "sales", discount=r6(F.avg("l_discount"))),
        _rows(li, "warehouse", cost=r6(F.avg("l_tax"))),
        _rows(hr, "hr", productivity=r6(F.avg("performance"))),
        _rows(mk, "marketing", revenue=F.round(F.sum("revenue"), 2)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def projection(spark: SparkSession, sf_dir: str, pcts=DEFAULT_PCTS) -> DataFrame:
    """Every known (department, metric) and every data-derived KPI x pct grid."""
    pairs = spark.createDataFrame(sorted({(d, m) for d, m, *_ in whatif.COEFFICIENTS} | set(KPI_PAIRS)),
                                  "department string, metric string")
    return whatif.project(whatif.scenario_grid(pairs, pcts), current_kpis(spark, sf_dir))


def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI3 on real KPIs: each impact as a share of the KPI's current value."""
    out = whatif.impacts(current_kpis(spark, sf_dir))
    return out.withColumn("impact_value", F.col("current") * F.col("impact") / F.lit(100.0))
