"""Figures of the one-scan summaries against the departments' own packs."""

import re

from pyspark.sql import functions as F

from kpiforge.plans import hr, marketing, one_scan, sales, transport
from kpiforge.sources import testbed
from kpiforge.sources.binding import Dim, Role, StarSource, TableSource

SALES = "product string, region string, salesperson string, date date, revenue double, units double"


def figures(df):
    return {(r.section, r.name, r.key): r.value for r in df.collect()}


def sales_table(spark):
    rows = [("a", "north", "x", "2024-01-05", 10.5, 2.0), ("b", "north", None, "2024-01-31", 4.25, 1.0), ("a", None, "y", "2024-02-01", None, 3.0),
            (None, "south", "x", None, 7.0, None), ("c", "south", "z", "2024-03-01", None, 0.0)]
    return spark.createDataFrame(rows, "product string, region string, salesperson string, day string, revenue double, units double").select(
        "product", "region", "salesperson", F.to_date("day").alias("date"), "revenue", "units")


def test_sales_with_nulls(spark):
    got = figures(one_scan.sales_rows(one_scan.sales_states(TableSource(sales_table(spark))), n=1))
    assert got[("metrics", "total_sales", None)] == 21.75 and got[("metrics", "total_units", None)] == 6
    assert got[("metrics", "avg_unit_price", None)] == 3.625 and got[("metrics", "num_transactions", None)] == 5
    assert {k[2]: v for k, v in got.items() if k[1] == "by_product"} == {"a": 2, "b": 1, "c": 1}
    assert {k[2]: v for k, v in got.items() if k[0] == "trends"} == {"2024-01": 14.75}   # months without a revenue have no trend
    assert {k[1:]: v for k, v in got.items() if k[0] == "performance"} == {
        ("top_products", "a"): 10.5, ("top_regions", "north"): 14.75, ("top_salespersons", "x"): 17.5}


def test_empty_sales(spark):
    got = figures(one_scan.sales_rows(one_scan.sales_states(TableSource(spark.createDataFrame([], SALES)))))
    assert got == {("metrics", m, None): 0 for m in ("total_sales", "total_units", "avg_unit_price", "num_transactions")}


def test_departments_equal_their_packs(spark):
    sf = "/root/testdata/sf0.001"
    shapes = one_scan.shapes(testbed.SUPPLY_COMPLETED)
    for d, pack in (("transport", transport), ("hr", hr), ("marketing", marketing)):
        src = testbed.SOURCES[d](spark, sf)
        got = figures(one_scan.additive_summary(src, shapes[d]))
        assert {n: v for (s, n, _), v in got.items() if s == "metrics"} == pack.metrics(src).first().asDict(), d
    assert got[("campaign_performance", "roi", "1-URGENT")] == sales_roi(spark, sf)
    effect = figures(one_scan.additive_summary(testbed.hr(spark, sf), shapes["hr"]))[("trends", "training", None)]
    assert effect == hr.training_effectiveness(testbed.hr(spark, sf)).first()[0]


def sales_roi(spark, sf):
    return marketing.performance(testbed.marketing(spark, sf)).where("section = 'campaign_performance' AND key = '1-URGENT'").first().roi


def star(spark, rows, names):
    """A fact with a key two hops away from its group's name, and a group of its own."""
    fact = spark.createDataFrame(rows, "fk long, own string, x double")
    mid = spark.createDataFrame([(k, k % 3 if k != 7 else None) for k in range(10)], "m_id long, m_to int")
    far = spark.createDataFrame(names, "n_id int, n_name string")
    return StarSource(lambda: fact, {"mid": Dim(lambda: mid, [("fk", "m_id")]), "far": Dim(lambda: far, [("m_to", "n_id")], ("mid",))},
                      {"x": Role(F.col("x")), "own": Role(F.col("own")), "mid": Role(F.col("m_to"), ("mid",)), "far": Role(F.col("n_name"), ("far",))})


def test_keyed_sums_equal_the_joined_rows(spark):
    rows = [(k % 13 if k % 11 else None, "ab"[k % 2] if k % 5 else None, float(k) if k % 7 else None) for k in range(400)] + [(1, "a", 1.0)] * 500
    src = star(spark, rows, [(0, "zero"), (1, "one"), (2, None)])
    got = src.keyed_sums({"o": "own", "m": "mid", "f": "far"}, {"n": F.count("*"), "s": F.sum("x")}, ["x"])
    flat = TableSource(src.frame("own", "mid", "far", "x")).keyed_sums({"o": "own", "m": "mid", "f": "far"}, {"n": F.count("*"), "s": F.sum("x")}, ["x"])
    as_set = lambda df: {(r.section, r.key, r.n, r.s) for r in df.collect()}
    assert as_set(got) == as_set(flat) and {r[0] for r in as_set(got)} == {"o", "m", "f"}


def test_keyed_sums_read_the_key_and_the_measures_only(spark):
    plan = sales.distributions(testbed.sales(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    read = {x for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if x.startswith("l_")}
    assert [sorted(x.split(",")) for x in read] == [["l_orderkey:bigint", "l_partkey:bigint", "l_suppkey:bigint"]]
