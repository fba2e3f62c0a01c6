"""Bind the driver's star-schema tables to the seven department shapes.

Each function returns a source whose roles are the canonical department
columns the packs read. Fact tables are joined to dimensions on unique
keys (left joins), and ``StarSource.frame`` joins only the dimensions a
request needs. nation/region have 25/5 rows by specification and are the
only broadcast sides; all other joins are left to Catalyst and AQE.

Derived grains:
* order grain (transport): lineitem aggregated per (order, ship day), then
  joined to orders and finished per order.
* customer grain (HR): the order grain aggregated per customer.
* campaign grain (marketing): orders JOIN customer aggregated per
  (priority, segment, month).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.sources.binding import Dim, Role, StarSource
from kpiforge.sources.tables import Tables
from kpiforge.staging import staged

# The five ticket statuses of the IT support table, in
# alphabetical order; the binding picks one per event from its ``k`` prop.
IT_STATUSES = ["Closed", "Escalated", "In Progress", "Pending", "Resolved"]

# Status value that counts as a completed procurement on the test tables.
SUPPLY_COMPLETED = "F"


def _date(c: str):
    return F.to_date(F.col(c))


def supply_chain(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    return StarSource(
        fact=lambda: t("lineitem"),
        dims={
            "orders": Dim(lambda: t("orders"), [("l_orderkey", "o_orderkey")]),
            "part": Dim(lambda: t("part"), [("l_partkey", "p_partkey")]),
            "supplier": Dim(lambda: t("supplier"), [("l_suppkey", "s_suppkey")]),
        },
        roles={
            "all_rows": Role(F.lit("all")),
            "order_key": Role(F.col("l_orderkey")),
            "line_number": Role(F.col("l_linenumber")),
            "item": Role(F.col("p_name"), ("part",)),
            "category": Role(F.col("p_type"), ("part",)),
            "supplier": Role(F.col("s_name"), ("supplier",)),
            "quantity": Role(F.col("l_quantity")),
            "unit_cost": Role(F.col("l_extendedprice")
                              / F.when(F.col("l_quantity") != 0, F.col("l_quantity"))),
            "total_cost": Role(F.col("l_extendedprice")),
            "order_date": Role(_date("o_orderdate"), ("orders",)),
            "delivery_date": Role(_date("l_shipdate")),
            "status": Role(F.col("o_orderstatus"), ("orders",)),
        },
    )


def sales(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    return StarSource(
        fact=lambda: t("lineitem"),
        dims={
            "orders": Dim(lambda: t("orders"), [("l_orderkey", "o_orderkey")]),
            "part": Dim(lambda: t("part"), [("l_partkey", "p_partkey")]),
            "supplier": Dim(lambda: t("supplier"), [("l_suppkey", "s_suppkey")]),
            "customer": Dim(lambda: t("customer"), [("o_custkey", "c_custkey")], ("orders",)),
            "nation": Dim(lambda: t("nation"), [("c_nationkey", "n_nationkey")], ("customer",),
                          broadcast=True),
            "region": Dim(lambda: t("region"), [("n_regionkey", "r_regionkey")], ("nation",),
                          broadcast=True),
        },
        roles={
            "order_key": Role(F.col("l_orderkey")),
            "line_number": Role(F.col("l_linenumber")),
            "product": Role(F.col("p_name"), ("part",)),
            "region": Role(F.col("r_name"), ("region",)),
            "salesperson": Role(F.col("s_name"), ("supplier",)),
            "date": Role(_date("o_orderdate"), ("orders",)),
            "revenue": Role(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))),
            "units": Role(F.col("l_quantity")),
        },
    )


def production(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    return StarSource(
        fact=lambda: t("lineitem"),
        dims={"part": Dim(lambda: t("part"), [("l_partkey", "p_partkey")])},
        roles={
            "production_id": Role(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                              F.col("l_linenumber").cast("string"))),
            "product": Role(F.col("p_type"), ("part",)),
            "units": Role(F.col("l_quantity")),
            "defects": Role(F.col("l_quantity") * F.col("l_discount")),
            "line": Role(F.col("l_linestatus")),
            "shift": Role(F.col("l_returnflag")),
            "utilization": Role(F.lit(100.0) * (F.lit(1.0) - F.col("l_tax"))),
            "date": Role(_date("l_shipdate")),
        },
    )


def it_support(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    k = F.regexp_extract(F.col("props"), r'"k": *(-?[0-9]+)', 1).cast("long")
    statuses = F.array(*[F.lit(s) for s in IT_STATUSES])
    return StarSource(
        fact=lambda: t("events"),
        dims={},
        roles={
            "ticket_id": Role(F.col("event_id")),
            "system": Role(F.col("event_type")),
            "issue": Role(F.concat(F.col("event_type"), F.lit("-"),
                                   F.pmod(F.col("user_id"), F.lit(8)).cast("string"))),
            "reported_at": Role(F.col("ts")),
            "hours": Role(F.col("value")),
            "status": Role(F.element_at(statuses, (F.pmod(k, F.lit(5)) + 1).cast("int"))),
        },
    )


def order_facts(t: Tables) -> DataFrame:
    """One row per order that has lines: line counts, delivery days, returns.

    The lines are summed per (order, ship day) before they meet their order.
    Partial aggregation leaves a task at most one row per order and day, so
    an order that holds a large share of all lines is small before any
    shuffle; the last step weighs each day by its line count.
    """
    day = F.to_date("l_shipdate").alias("f_day")
    days = (t("lineitem").groupBy("l_orderkey", day)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("l_returnflag") == "R").alias("returned"),
                 F.sum("l_quantity").alias("quantity"),
                 F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax")))
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    late = F.datediff(F.col("f_day"), F.to_date("o_orderdate"))
    timed = F.sum(F.when(late.isNotNull(), F.col("n")))
    return (days.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("o_orderkey")
                .agg(F.any_value("o_custkey").alias("o_custkey"),
                     F.any_value("o_orderdate").alias("o_orderdate"),
                     F.any_value("o_orderpriority").alias("o_orderpriority"),
                     F.sum("n").alias("f_lines"),
                     (F.sum(late * F.col("n")) / timed).alias("f_delivery_days"),
                     (F.sum(F.when(late <= 0, F.col("n")).when(late > 0, F.lit(0))) / timed * 100.0)
                     .alias("f_on_time_rate"),
                     F.coalesce(F.sum(F.when(late > 0, F.col("n"))), F.lit(0)).alias("f_late_lines"),
                     F.sum("returned").alias("f_returned_lines"),
                     F.sum("quantity").alias("f_quantity"),
                     F.sum("tax").alias("f_tax")))


def transport(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    return StarSource(
        fact=lambda: order_facts(t),
        dims={"customer": Dim(lambda: t("customer"), [("o_custkey", "c_custkey")])},
        roles={
            "employee_id": Role(F.col("o_orderkey")),
            "role": Role(F.col("c_mktsegment"), ("customer",)),
            "entry_date": Role(_date("o_orderdate")),
            "deliveries": Role(F.col("f_lines")),
            "delivery_time": Role(F.col("f_delivery_days")),
            "vehicle": Role(F.col("o_orderpriority")),
            "condition": Role((F.pmod(F.col("o_custkey"), F.lit(10)) + 1).cast("int")),
            "fuel": Role(F.col("f_quantity")),
            "maintenance": Role(F.col("f_tax")),
            "on_time_rate": Role(F.col("f_on_time_rate")),
            "incidents": Role(F.col("f_returned_lines")),
        },
    )


def customer_facts(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """One row per customer with orders (the HR "employee"); ``orders``: stored order facts."""
    return ((order_facts(t) if orders is None else orders)
            .groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("h_orders"),
                 F.min("o_orderdate").alias("h_first_order"),
                 F.sum("f_lines").alias("h_lines"),
                 F.sum("f_late_lines").alias("h_late_lines"),
                 F.sum("f_returned_lines").alias("h_returned_lines")))


def hr(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    return StarSource(
        fact=lambda: customer_facts(t),
        dims={
            "customer": Dim(lambda: t("customer"), [("o_custkey", "c_custkey")]),
            "nation": Dim(lambda: t("nation"), [("c_nationkey", "n_nationkey")], ("customer",),
                          broadcast=True),
        },
        roles={
            "employee_id": Role(F.col("o_custkey")),
            "department": Role(F.col("c_mktsegment"), ("customer",)),
            "position": Role(F.col("n_name"), ("nation",)),
            "salary": Role(F.col("c_acctbal"), ("customer",)),
            "hired": Role(_date("h_first_order")),
            "performance": Role(F.col("h_orders")),
            "training_hours": Role(F.col("h_lines")),
            "leave_days": Role(F.col("h_late_lines")),
            "overtime_hours": Role(F.col("h_returned_lines")),
            "resigned": Role((F.col("c_acctbal") < 0).cast("int"), ("customer",)),
        },
    )


def campaign_facts(t: Tables) -> DataFrame:
    """Orders grouped into campaigns by priority x customer segment x month."""
    o = t("orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                           "o_orderpriority")
    c = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    ym = F.date_format(F.col("o_orderdate"), "yyyy-MM")
    return (o.join(c, o["o_custkey"] == c["c_custkey"], "left")
             .groupBy(F.col("o_orderpriority").alias("campaign_type"),
                      F.col("c_mktsegment").alias("channel"), ym.alias("month"))
             .agg(F.to_date(F.min("o_orderdate")).alias("start_date"),
                  F.to_date(F.max("o_orderdate")).alias("end_date"),
                  F.sum(F.abs(F.col("c_acctbal"))).alias("budget"),
                  F.count(F.lit(1)).alias("leads"),
                  (F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100.0)
                  .alias("conversion_rate"),
                  F.sum("o_totalprice").alias("revenue")))


def marketing(spark: SparkSession, sf_dir: str) -> StarSource:
    t = Tables(spark, sf_dir)
    cols = ["campaign_type", "channel", "start_date", "end_date", "budget", "leads",
            "conversion_rate", "revenue"]
    roles = {c: Role(F.col(c)) for c in cols}
    roles["campaign_id"] = Role(F.concat_ws("|", "campaign_type", "channel", "month"))
    return StarSource(fact=lambda: campaign_facts(t), dims={}, roles=roles)


SOURCES = {
    "supply_chain": supply_chain,
    "sales": sales,
    "production": production,
    "it": it_support,
    "transport": transport,
    "hr": hr,
    "marketing": marketing,
}

#: What supply chain reads of lines joined with their orders, and what sales reads besides.
SUPPLY_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "o_orderdate", "o_orderstatus"]
SALES_COLUMNS = ["l_quantity", "l_discount", "o_custkey"]


def stored_sources(spark: SparkSession, sf_dir: str, departments: Sequence[str]) -> dict[str, StarSource]:
    """Sources of several departments for many requests: joins and grains that several sections read are stored once.

    Lines meet their orders once, for supply chain and sales; the order grain is computed once, for
    transport and HR, and so are the customer grain and the campaign grain.
    """
    t = Tables(spark, sf_dir)
    out = {d: SOURCES[d](spark, sf_dir) for d in departments}
    if "supply_chain" in out:
        out["supply_chain"] = out["supply_chain"].stored(["orders"], [*SUPPLY_COLUMNS, *(SALES_COLUMNS if "sales" in out else [])], "lines")
        if "sales" in out:
            out["sales"] = out["sales"].over_join_of(out["supply_chain"])
    if "transport" in out or "hr" in out:
        orders = staged(order_facts(t), "order-facts")
        if "transport" in out:
            out["transport"] = out["transport"].over(lambda: orders)
        if "hr" in out:
            customers = staged(customer_facts(t, orders), "customer-facts")
            out["hr"] = out["hr"].over(lambda: customers)
    if "marketing" in out:
        campaigns = staged(campaign_facts(t), "campaign-facts")
        out["marketing"] = out["marketing"].over(lambda: campaigns)
    return out
