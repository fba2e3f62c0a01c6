"""Sales pack (SA1-SA6, AG8, SO4).

Roles: product, region, salesperson, date, revenue, units. The reference
guards every section on column presence (PRJ14): a ``TableSource`` reads a
missing role as nulls, sums over it are 0 and groups by it are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions import fmt_date, month_bucket, safe_ratio
from kpiforge.operators.topk import top_per_section
from kpiforge.plans.common import MEAN_DIGITS, SUM_DIGITS, numbered, rsum

SECTIONS = {"top_products": "product", "top_regions": "region",
            "top_salespersons": "salesperson"}


def metrics(src) -> DataFrame:
    """SA1: revenue, units, revenue per unit (0 if no units), transactions."""
    df = src.frame("revenue", "units")
    rev, units = F.sum("revenue"), F.sum("units")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(zero(F.round(rev, SUM_DIGITS)).alias("total_sales"),
                  zero(F.round(units, SUM_DIGITS).cast("double")).alias("total_units"),
                  zero(F.round(safe_ratio(rev, units), MEAN_DIGITS)).alias("avg_unit_price"),
                  F.count(F.lit(1)).alias("num_transactions"))


def distributions(src) -> DataFrame:
    """SA2: row counts by product, region, salesperson."""
    return src.keyed_sums({"by_product": "product", "by_region": "region", "by_salesperson": "salesperson"},
                          {"n": F.count(F.lit(1))}, [])


def monthly_trends(src) -> DataFrame:
    """SA3: revenue by ``yyyy-MM``."""
    df = src.frame("date", "revenue")
    return (df.where(F.col("date").isNotNull() & F.col("revenue").isNotNull())
              .groupBy(month_bucket("date", "year_month").alias("month"))
              .agg(rsum("revenue").alias("revenue")))


def _grouped_revenue(src) -> DataFrame:
    return src.keyed_sums(SECTIONS, {"revenue": F.sum("revenue")}, ["revenue"]).where(
        F.col("revenue").isNotNull())


def top_performers(src, n: int = 5) -> DataFrame:
    """SA4: top ``n`` products / regions / salespersons by revenue."""
    top = top_per_section(_grouped_revenue(src), "revenue", n)
    return top.withColumn("revenue", F.round("revenue", SUM_DIGITS))


def recent_sales(src, n: int = 10) -> DataFrame:
    """SA5: latest sales by date; ties broken on every output column."""
    columns = ["date", "product", "region", "salesperson", "revenue", "units"]
    revenue = F.round("revenue", SUM_DIGITS)
    top = src.latest("date", n, columns, ties=["product", "region", "salesperson", revenue, "units"],
                     keys=["order_key", "line_number"])
    return top.withColumns({"revenue": revenue, "date": fmt_date("date")}).select(*columns)


def insights(src) -> DataFrame:
    """SA6: four KPI strings plus the top product, region and salesperson."""
    df = src.frame("revenue", "units")
    best = top_per_section(_grouped_revenue(src), "revenue", 1)
    # one subquery (a struct of the three winners) instead of one per section
    tops = best.agg(F.struct(*[F.max(F.when(F.col("section") == s, F.col("key"))).alias(s)
                               for s in SECTIONS]).alias("t")).scalar()

    def top_of(section: str):
        return tops[section]

    rev, units = F.sum("revenue"), F.sum("units")
    base = df.agg(rev.alias("r"), units.alias("u"), safe_ratio(rev, units).alias("p"),
                  F.count(F.lit(1)).alias("n"))
    return numbered(base, [
        F.format_string("Total sales revenue: $%.2f", F.bround("r", 2)),
        F.format_string("Total units sold: %d", F.round("u", 0).cast("long")),
        F.format_string("Average unit price: $%.2f", F.bround("p", 2)),
        F.format_string("Number of transactions: %d", "n"),
        F.concat(F.lit("Top selling product: "), top_of("top_products")),
        F.concat(F.lit("Top performing region: "), top_of("top_regions")),
        F.concat(F.lit("Top salesperson: "), top_of("top_salespersons")),
    ])
