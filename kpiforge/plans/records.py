"""Operational records: audit log with users, file names, badges, scopes, reports (JN3, SNK7, SRC4, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions import file_extension, safe_name
from kpiforge.functions.dates import iso_or_null
from kpiforge.functions.numeric import parse_number
from kpiforge.operators.aggregate import distinct_values
from kpiforge.operators.derive import badge_class, scope_to, where_equals, yes_no_to_int
from kpiforge.operators.joins import logs_with_users
from kpiforge.operators.topk import last_n
from kpiforge.plans.summary import build_summary
from kpiforge.session import ensure_checkpoint_dir
from kpiforge.sinks.summary import hr_report_tables, metric_values
from kpiforge.sources import testbed
from kpiforge.sources.intake import ingest_dataset, read_manifest, read_uploads
from kpiforge.sources.summary import with_default_metrics
from kpiforge.sources.tables import Tables

#: Order status -> display class of its badge.
BADGES = {"F": "success", "O": "warning"}
DEFAULT_BADGE = "secondary"
SCOPE = "BUILDING"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3, FN13, FN15: events with their user's name, ISO time and the number in ``props``."""
    t = Tables(spark, sf_dir)
    logs = logs_with_users(t("events"), t("customer").select("c_custkey", "c_name"), "user_id", "c_custkey")
    return logs.select("event_id", F.col("c_name").alias("user_name"), iso_or_null("ts").alias("at"),
                       parse_number("props").alias("amount"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11, FN12: a file name and its extension for every part."""
    p = Tables(spark, sf_dir)("part")
    name = F.concat(safe_name(F.concat_ws("/", "p_name", "p_type")), F.lit("."), F.col("p_brand"))
    return p.select("p_partkey", name.alias("file"), file_extension(name).alias("extension"),
                    file_extension("p_name").alias("no_extension"))


def order_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4, PRJ16: orders per badge class, and how many of them are urgent."""
    o = Tables(spark, sf_dir)("orders")
    urgent = yes_no_to_int(F.when(F.col("o_orderpriority").startswith("1"), "Yes").when(
        F.col("o_orderpriority").startswith("5"), "No"))
    return (o.groupBy(badge_class("o_orderstatus", BADGES, DEFAULT_BADGE).alias("badge"))
            .agg(F.count("*").alias("n"), F.sum(urgent).cast("long").alias("urgent")))


def scoped_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ12, PRJ13: customers as a department's user and as an administrator see them."""
    c = Tables(spark, sf_dir)("customer")
    view = lambda name, d: d.agg(F.lit(name).alias("view"), F.count("*").alias("n"),
                                 F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return (view("user", scope_to(c, SCOPE, False, "c_mktsegment"))
            .unionByName(view("admin", scope_to(c, SCOPE, True, "c_mktsegment")))
            .unionByName(view("nation 0", where_equals(c, "c_nationkey", 0))))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9: the event types there are."""
    return distinct_values(Tables(spark, sf_dir)("events"), "event_type")


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3: the last ten events by id."""
    return last_n(Tables(spark, sf_dir)("events"), "event_id", 10).select("event_id", "event_type", "user_id")


def metrics_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: IT metrics over a table without rows and over the whole table, defaults filled in."""
    from kpiforge.plans import it
    from kpiforge.sources.binding import TableSource

    src = testbed.it_support(spark, sf_dir)
    df = src.frame("hours")
    defaults = {"total_tickets": 0, "avg_resolution_time": 0.0, "satisfaction": 4.2}
    pick = lambda name, d: with_default_metrics(it.metrics(TableSource(d)), defaults).select(
        F.lit(name).alias("frame"), "total_tickets", "avg_resolution_time", "satisfaction")
    return pick("none", df.where("hours IS NULL AND hours IS NOT NULL")).unionByName(pick("all", df))


def hr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: the HR report's rows: sheet 1 the metrics, sheet 2 insights and recommendations side by side."""
    summary = build_summary("hr", testbed.hr(spark, sf_dir))
    none = lambda t: F.lit(None).cast(t)
    said = lambda c: F.concat_ws(": ", F.get_json_object(c, "$.title"), F.get_json_object(c, "$.description"))
    sheet1 = metric_values(summary, "hr").select(
        F.lit("metrics").alias("sheet"), F.lit(0).alias("position"), F.col("metric").alias("name"),
        F.round(F.col("v").cast("double"), 4).alias("value"), none("string").alias("insight"), none("string").alias("recommendation"))
    sheet2 = hr_report_tables(summary)[1].select(
        F.lit("analysis").alias("sheet"), "position", none("string").alias("name"), none("double").alias("value"),
        *[F.when(F.col(c).isNotNull(), said(c)).alias(c) for c in ("insight", "recommendation")])
    return sheet1.unionByName(sheet2)


def intake_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: ticket files of every event type are uploaded, one of them twice; per upload: rows accepted, rejected, readable, and their hours.

    The files are the events as CSV; hours of users whose id 50 divides are text, so their rows are rejected.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/intake-{uuid.uuid4().hex}"
    events = Tables(spark, sf_dir)("events")
    hours = F.when(F.col("user_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string"))
    tickets = events.select(F.col("event_id").alias("Employee ID"), F.col("event_type").alias("System Name"), hours.alias("Resolution Time (hrs)"))
    types = [r.event_type for r in events.select("event_type").where("event_type IS NOT NULL").distinct().orderBy("event_type").collect()]   # a file for each
    for kind in [*types, types[0]]:
        path = f"{root}/inbox/{kind}.csv"
        tickets.where(F.col("System Name") == kind).write.mode("overwrite").option("header", True).csv(path)
        ingest_dataset(spark, path, "it", kind, f"{root}/store")
    stored = read_uploads(spark, f"{root}/store", "it").groupBy("upload").agg(
        F.count("*").alias("stored"), F.round(F.sum("Resolution Time (hrs)"), 2).alias("hours"))
    return read_manifest(spark, f"{root}/store").join(stored, "upload").select("filename", "department", "accepted", "rejected", "stored", "hours")
