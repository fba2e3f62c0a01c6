"""Additive summary sections of a department from one scan (ALL3), and from day states (SRC3).

Every department lists its sections (what rows are grouped by), its measures, and which figures of
which section make up the summary. One expand and one aggregation give the states of all sections;
the summary rows (section, name, key, value) are read off them. Sales, whose groups lie in large
dimensions, sums by foreign keys first (``sales_states``), so that raw rows meet no dimension.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions import month_bucket, safe_ratio
from kpiforge.operators.additive import deviation, mean, merged_states, partial_states
from kpiforge.operators.derive import delay_days, efficiency_rate, total_active_time
from kpiforge.operators.topk import top_per_section
from kpiforge.plans.common import MEAN_DIGITS, SUM_DIGITS
from kpiforge.plans.it import SYSTEM_UPTIME
from kpiforge.session import ensure_checkpoint_dir
from kpiforge.sources import daystate, testbed
from kpiforge.staging import staged


@dataclass
class Shape:
    """roles read; sections and measures as columns; figures: state section -> (section, name, value).

    ``beyond`` gives further summary rows that compare states of several keys.
    """

    roles: list[str]
    sections: dict[str, Column]
    measures: dict[str, Column]
    figures: dict[str, list[tuple[str, str, Column]]]
    beyond: Callable[[DataFrame], DataFrame] | None = None


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _mean(m: str, digits: int = MEAN_DIGITS) -> Column:
    return F.round(mean(m), digits)


def _total(m: str, digits: int = SUM_DIGITS) -> Column:
    return F.round(f"{m}_sum", digits)


def shapes(completed: str) -> dict[str, Shape]:
    delay = delay_days("delivery_date", "order_date")
    efficiency = efficiency_rate("units", "defects")
    campaign = [(f, F.round(f"{f}_sum", SUM_DIGITS)) for f in ("budget", "leads", "revenue")] + [("roi", _roi())]
    return {
        "supply_chain": Shape(
            ["category", "supplier", "order_date", "delivery_date", "total_cost", "status"],
            {"all": F.lit("all"), "category": F.col("category"), "supplier": F.col("supplier"), "month": month_bucket("order_date", "year_month")},
            {"cost": F.col("total_cost"), "delay": delay, "on_time": _flag(delay <= 0), "done": _flag(F.col("status") == F.lit(completed))},
            {"all": [("metrics", "total_cost", _total("cost")), ("metrics", "avg_delay", _mean("delay", 2)),
                     ("metrics", "on_time_delivery", F.round(mean("on_time") * 100, 2)), ("metrics", "total_orders", F.col("n")),
                     ("metrics", "avg_order_value", F.round(F.col("cost_sum") / F.col("n"), 2))],
             "category": [("distributions", "category_costs", _total("cost"))],
             "supplier": [("distributions", "supplier_costs", _total("cost")), ("performance", "avg_delay", _mean("delay")),
                          ("performance", "total_cost", _total("cost")), ("performance", "completion_rate", _mean("done"))],
             "month": [("trends", "monthly_cost", _total("cost")), ("trends", "monthly_delay", _mean("delay"))]}),
        "production": Shape(
            ["product", "line", "shift", "date", "units", "defects", "utilization"],
            {"all": F.lit("all"), "product": F.col("product"), "line": F.col("line"), "shift": F.col("shift"), "month": month_bucket("date", "month_of_year")},
            {"efficiency": efficiency, "utilization": F.col("utilization")},
            {"all": [("metrics", "total_operations", F.col("n")), ("metrics", "avg_efficiency", _mean("efficiency")),
                     ("metrics", "avg_quality_score", _mean("efficiency")), ("metrics", "avg_machine_utilization", _mean("utilization"))],
             "product": [("distributions", "product_lines", F.col("n")), ("performance", "by_product", _mean("efficiency"))],
             "line": [("distributions", "production_lines", F.col("n")), ("performance", "by_line", _mean("efficiency"))],
             "shift": [("distributions", "shifts", F.col("n")), ("performance", "by_shift", _mean("efficiency"))],
             "month": [("trends", "avg_efficiency", _mean("efficiency"))]}),
        "it": Shape(
            ["system", "issue", "status", "reported_at", "hours"],
            {"all": F.lit("all"), "system": F.col("system"), "issue": F.col("issue"), "status": F.col("status"), "month": month_bucket("reported_at", "month_of_year")},
            {"hours": F.col("hours"), "first": _flag(F.col("hours") <= 1)},
            {"all": [("metrics", "total_tickets", F.col("n")), ("metrics", "avg_resolution_time", _mean("hours")),
                     ("metrics", "first_call_resolution", F.round(mean("first") * 100, MEAN_DIGITS)), ("metrics", "system_uptime", F.lit(SYSTEM_UPTIME))],
             "issue": [("distributions", "ticket_types", F.col("n")), ("performance", "by_issue", _mean("hours"))],
             "system": [("distributions", "systems", F.col("n")), ("performance", "by_system", _mean("hours"))],
             "status": [("distributions", "status", F.col("n"))],
             "month": [("trends", "avg_resolution_time", _mean("hours"))]}),
        "transport": Shape(
            ["vehicle", "role", "entry_date", "deliveries", "delivery_time", "on_time_rate", "incidents"],
            {"all": F.lit("all"), "vehicle": F.col("vehicle"), "role": F.col("role"), "month": month_bucket("entry_date", "year_month")},
            {m: F.col(m) for m in ("deliveries", "delivery_time", "on_time_rate", "incidents")},
            {"all": [("metrics", "total_deliveries", F.col("deliveries_sum")), ("metrics", "avg_delivery_time", _mean("delivery_time", 1)),
                     ("metrics", "avg_on_time_rate", _mean("on_time_rate", 1)), ("metrics", "total_incidents", F.col("incidents_sum"))],
             "vehicle": [("distributions", "vehicle_types", F.col("n")), ("performance", "by_vehicle_type", _mean("delivery_time"))],
             "role": [("distributions", "roles", F.col("n"))],
             "month": [("performance", "monthly_trends", F.col("deliveries_sum")), ("trends", "avg_delivery_time", _mean("delivery_time")),
                       ("trends", "avg_on_time_rate", _mean("on_time_rate"))]}),
        "hr": Shape(
            ["department", "performance", "training_hours", "overtime_hours", "leave_days", "resigned"],
            {"all": F.lit("all"), "department": F.col("department"), "performance": F.col("performance"), "hours": F.col("training_hours")},
            {"active": total_active_time("training_hours", "overtime_hours", "leave_days"), "training": F.col("training_hours"),
             "performance": F.col("performance"), "resigned": F.col("resigned")},
            {"all": [("metrics", "total_employees", F.col("n")), ("metrics", "avg_tenure", _mean("active")),
                     ("metrics", "training_completion", _mean("training")), ("metrics", "satisfaction_score", _mean("performance"))],
             "department": [("distributions", "departments", F.col("n")), ("department_insights", "avg_performance", _mean("performance")),
                            ("department_insights", "attrition_rate", _mean("resigned"))],
             "performance": [("distributions", "performance", F.col("n"))]},
            beyond=_training_effect),
        "marketing": Shape(
            ["campaign_type", "channel", "budget", "leads", "conversion_rate", "revenue"],
            {"all": F.lit("all"), "campaign_type": F.col("campaign_type"), "channel": F.col("channel")},
            {"budget": F.col("budget"), "leads": F.col("leads"), "rate": F.col("conversion_rate"), "revenue": F.col("revenue"),
             "converted": F.col("leads") * F.col("conversion_rate") / F.lit(100.0)},
            {"all": [("metrics", "total_campaigns", F.col("n")), ("metrics", "conversion_rate", _mean("rate")),
                     ("metrics", "acquisition_cost", F.round(F.col("budget_sum") / F.col("converted_sum"), MEAN_DIGITS)), ("metrics", "roi", _roi())],
             "campaign_type": [("campaign_performance", f, v) for f, v in campaign],
             "channel": [("channel_effectiveness", f, v) for f, v in campaign]}),
    }


def _roi() -> Column:
    return F.round((F.col("revenue_sum") - F.col("budget_sum")) / F.col("budget_sum") * F.lit(100.0), MEAN_DIGITS)


def _training_effect(states: DataFrame) -> DataFrame:
    """HR6 from the states by training hours: correlation of the hours and their mean performance."""
    effect = F.round(F.corr(F.col("key").cast("double"), mean("performance")), MEAN_DIGITS)
    return states.where("section = 'hours'").agg(effect.alias("value")).select(
        F.lit("trends").alias("section"), F.lit("training").alias("name"), F.lit(None).cast("string").alias("key"), "value")


def summary_rows(states: DataFrame, shape: Shape) -> DataFrame:
    """(section, name, key, value) of merged states; metrics have no key."""
    rows = [F.when(F.col("section") == state, F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.when(F.lit(state != "all"), F.col("key")).alias("key"), v.cast("double").alias("value"))
        for s, n, v in figures])) for state, figures in shape.figures.items()]
    out = states.select(F.inline(F.coalesce(*rows)))
    return out.unionByName(shape.beyond(states)) if shape.beyond else out


def additive_summary(src, shape: Shape) -> DataFrame:
    """All additive sections of a source from one scan."""
    return summary_rows(partial_states(src.frame(*shape.roles), shape.sections, shape.measures), shape)


def sales_states(src) -> DataFrame:
    """(section, key, n, revenue, rows, units): sums by product, region, salesperson and day, and over all."""
    measures = {"n": F.count("*"), "rows": F.count("revenue"), "revenue": F.sum("revenue"), "units": F.sum("units")}
    groups = src.keyed_sums({s: s for s in ("product", "region", "salesperson", "date")}, measures, ["revenue", "units"])
    whole = src.frame("revenue", "units").agg(*[m.alias(k) for k, m in measures.items()])
    return groups.unionByName(whole.select(F.lit("all").alias("section"), F.lit("all").alias("key"), "*"))


#: Revenues have four decimals; rounded to these, a sum doesn't depend on its order.
REVENUE_DIGITS = 4


def sales_rows(states: DataFrame, n: int = 5) -> DataFrame:
    """Summary rows (section, name, key, value) of ``sales_states``; the ``n`` best of each group by revenue."""
    def rows(df: DataFrame, *figures: tuple) -> DataFrame:
        one = [F.struct(F.lit(s).alias("section"), (F.lit(m) if isinstance(m, str) else m).alias("name"), k.alias("key"), v.cast("double").alias("value"))
               for s, m, k, v in figures]
        return df.select(F.inline(F.array(*one)))

    none, key, total = F.lit(None).cast("string"), F.col("key"), F.round("revenue", REVENUE_DIGITS)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    groups = states.where(F.col("section").isin("product", "region", "salesperson"))
    months = (states.where("section = 'date' AND rows > 0").groupBy(F.substring("key", 1, 7).alias("key"))
              .agg(F.sum("revenue").alias("revenue")))
    best = top_per_section(groups.where("rows > 0").select(F.concat(F.lit("top_"), "section", F.lit("s")).alias("section"), "key", "revenue"), "revenue", n)
    return (rows(states.where("section = 'all'"),
                 ("metrics", "total_sales", none, zero(total)), ("metrics", "total_units", none, zero(F.round("units", SUM_DIGITS))),
                 ("metrics", "avg_unit_price", none, zero(F.round(safe_ratio(F.col("revenue"), F.col("units")), MEAN_DIGITS))),
                 ("metrics", "num_transactions", none, F.col("n")))
            .unionByName(rows(groups, ("distributions", F.concat(F.lit("by_"), "section"), key, F.col("n"))))
            .unionByName(rows(months, ("trends", "revenue", key, total)))
            .unionByName(rows(best, ("performance", F.col("section"), key, total))))


def summary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALL3: the figures of every department's summary, with their values.

    The states of sales are staged: groups, months and the best are read off them.
    """
    parts = {d: additive_summary(testbed.SOURCES[d](spark, sf_dir), shape) for d, shape in shapes(testbed.SUPPLY_COMPLETED).items()}
    parts["sales"] = sales_rows(staged(sales_states(testbed.sales(spark, sf_dir)), "sales-states"))
    return reduce(DataFrame.unionByName, [p.select(F.lit(d).alias("department"), "*") for d, p in parts.items()])


def refreshed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: the supply-chain summary from day states, refreshed after the last day of orders came in.

    The facts are stored by order day, first all days but the last, then the last; ``refreshed`` is the
    number of days that the second refresh recomputed. Cost deviations come from the merged squares.
    """
    shape, root = shapes(testbed.SUPPLY_COMPLETED)["supply_chain"], f"{ensure_checkpoint_dir(spark).rstrip('/')}/days-{uuid.uuid4().hex}"
    facts = staged(testbed.supply_chain(spark, sf_dir).frame(*shape.roles).where("order_date IS NOT NULL"), "day-facts")
    last = facts.agg(F.max("order_date")).scalar()

    def arrive(rows: DataFrame) -> None:
        rows.withColumn("day", F.date_format("order_date", "yyyy-MM-dd")).repartition("day").write.mode("append").partitionBy("day").parquet(f"{root}/facts")

    def partial(rows: DataFrame) -> DataFrame:
        return partial_states(rows, shape.sections, shape.measures, by=["day"])

    arrive(facts.where(F.col("order_date") < last))
    daystate.refresh(spark, f"{root}/facts", f"{root}/state", partial)
    arrive(facts.where(F.col("order_date") == last))
    days = daystate.refresh(spark, f"{root}/facts", f"{root}/state", partial)
    states = merged_states(daystate.day_states(spark, f"{root}/state"), list(shape.measures))
    spread = states.where("section = 'supplier'").select(
        F.lit("performance").alias("section"), F.lit("cost_deviation").alias("name"), "key", F.round(deviation("cost"), SUM_DIGITS).alias("value"))
    return summary_rows(states, shape).unionByName(spread).withColumn("refreshed", F.lit(len(days)))
