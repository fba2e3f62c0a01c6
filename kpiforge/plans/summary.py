"""Department summary assembly (ALL3).

A summary is a long table

    department, section, name, key, value   (value = JSON text of the row)

built as a ``unionByName`` of every section of a department pack. Each
section stays its own small aggregation job; the union is written once.
Nothing is collected to the driver; ``sinks.summary`` writes the table, or
one nested JSON document per department.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.operators.insights import recommendations
from kpiforge.plans import hr, it, marketing, production, sales, supply_chain, transport
from kpiforge.session import ensure_checkpoint_dir
from kpiforge.sinks.summary import metric_values, read_summary_documents, write_summary_documents
from kpiforge.sources import testbed

SUMMARY_SCHEMA = "department string, section string, name string, key string, value string"


def long_form(df: DataFrame, department: str, section: str, name: str | Column | None = None,
              key: str | Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """Turn any section frame into summary rows.

    ``name``/``key``: a column name or Column (e.g. the ``section`` column of
    a multi-section frame) or None. ``order``: for ranked lists, the key is
    the 1-based position under this order (lists are at most a few rows).
    """
    def as_col(x):
        if x is None:
            return F.lit(None).cast("string")
        return (F.col(x) if isinstance(x, str) else x).cast("string")

    if order is not None:
        df = df.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
        key = F.col("_pos")
    used = {c for c in (name, key) if isinstance(c, str)} | {"_pos"}
    payload = [c for c in df.columns if c not in used]
    return df.select(F.lit(department).alias("department"), F.lit(section).alias("section"),
                     as_col(name).alias("name"), as_col(key).alias("key"),
                     F.to_json(F.struct(*payload)).alias("value"))


def _recs(src, department: str) -> DataFrame:
    spark = SparkSession.getActiveSession()
    return long_form(recommendations(spark, department).drop("department"), department,
                     "recommendations", key="idx")


def _sections(department: str, completed: str | None = None) -> list[Callable]:
    d, done = department, {"completed": completed} if completed else {}
    if d == "supply_chain":
        m = supply_chain
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.monthly_trends(s), d, "trends", key="month"),
                lambda s: long_form(m.supplier_performance(s, **done), d, "performance", key="supplier"),
                lambda s: long_form(m.analysis(s), d, "analysis"),
                lambda s: long_form(m.recent_orders(s), d, "recent_orders",
                                    order=[F.desc("date"), F.asc("category"),
                                           F.asc("description"), F.asc("amount")])]
    if d == "it":
        m = it
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.monthly_trends(s), d, "trends", key="month"),
                lambda s: long_form(m.performance(s), d, "performance", "section", "key"),
                lambda s: long_form(m.insights(s), d, "insights", key="idx"),
                lambda s: _recs(s, d),
                lambda s: long_form(m.recent_tickets(s), d, "recent_tickets",
                                    order=[F.desc("reported_date"), F.asc("ticket_id")])]
    if d == "production":
        m = production
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.monthly_trends(s), d, "trends", key="month"),
                lambda s: long_form(m.performance(s), d, "performance", "section", "key"),
                lambda s: long_form(m.insights(s), d, "insights", key="idx"),
                lambda s: _recs(s, d),
                lambda s: long_form(m.recent_operations(s), d, "recent_operations",
                                    order=[F.desc("date"), F.asc("production_id")])]
    if d == "sales":
        m = sales
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.monthly_trends(s), d, "trends", key="month"),
                lambda s: long_form(m.top_performers(s), d, "performance", "section", "key"),
                lambda s: long_form(m.insights(s), d, "insights", key="idx"),
                lambda s: _recs(s, d),
                lambda s: long_form(m.recent_sales(s), d, "recent_sales",
                                    order=[F.desc("date"), F.asc("product")])]
    if d == "transport":
        m = transport
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.by_vehicle(s), d, "performance", F.lit("by_vehicle_type"),
                                    key="vehicle"),
                lambda s: long_form(m.monthly_deliveries(s), d, "performance", F.lit("monthly_trends"),
                                    key="month"),
                lambda s: long_form(m.monthly_service(s), d, "trends", key="month"),
                lambda s: long_form(m.insights(s), d, "insights", key="idx"),
                lambda s: _recs(s, d)]
    if d == "hr":
        m = hr
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.distributions(s), d, "distributions", "section", "key"),
                lambda s: long_form(m.department_insights(s), d, "department_insights",
                                    key="department"),
                lambda s: long_form(m.top_performers(s), d, "top_performers",
                                    order=[F.desc("performance_score"), F.asc("employee_id")]),
                lambda s: long_form(m.training_effectiveness(s), d, "trends", F.lit("training")),
                lambda s: long_form(m.insight_records(s), d, "insights", key="idx"),
                lambda s: _recs(s, d),
                lambda s: long_form(m.training_recommendations(s), d, "training_recommendations",
                                    key="employee_id")]
    if d == "marketing":
        m = marketing
        return [lambda s: long_form(m.metrics(s), d, "metrics"),
                lambda s: long_form(m.performance(s), d, "performance", "section", "key"),
                lambda s: _recs(s, d),
                lambda s: long_form(m.recent_campaigns(s), d, "recent_campaigns",
                                    order=[F.desc("start_date"), F.asc("campaign_id")])]
    raise KeyError(department)


def build_summary(department: str, src, completed: str | None = None) -> DataFrame:
    """ALL3: every section of one department as summary rows. ``completed``: the status of a completed procurement, if not the usual one."""
    parts = [fn(src) for fn in _sections(department, completed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


DEPARTMENTS = ("supply_chain", "it", "production", "sales", "transport", "hr", "marketing")


def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALL3: rows of every section of every department's summary."""
    out = None
    for d, src in testbed.stored_sources(spark, sf_dir, DEPARTMENTS).items():
        part = build_summary(d, src).groupBy("department", "section").agg(
            F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: the metrics sections of the summaries as (department, metric, value) rows."""
    out = None
    for d in DEPARTMENTS:
        part = metric_values(build_summary(d, testbed.SOURCES[d](spark, sf_dir)), d).select(
            F.lit(d).alias("department"), "metric", F.round(F.col("v").cast("double"), 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: figures of the nested summary documents of supply chain, production and IT, written and read again."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    sources = testbed.stored_sources(spark, sf_dir, ("supply_chain", "production", "it"))
    parts = [build_summary(d, src, testbed.SUPPLY_COMPLETED) for d, src in sources.items()]
    write_summary_documents(reduce(DataFrame.unionByName, parts), root)
    rows = read_summary_documents(spark, root).where(F.col("section").isin("metrics", "distributions", "trends", "performance"))
    fields = rows.select("department", "section", "name", "key", F.explode(F.from_json("value", "map<string,string>")).alias("field", "v"))
    return fields.select("department", "section", F.coalesce("name", "field").alias("name"), "key", F.col("v").cast("double").alias("value"))
