"""Physical-plan properties that matter at scale (checked with explain())."""

import os

import pytest

from kpiforge.plans import hr, production, sales, supply_chain
from kpiforge.sources import testbed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # cluster-scale sizes
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_monthly_trend_joins_only_what_it_reads(spark, capsys):
    p = plan(supply_chain.monthly_trends(testbed.supply_chain(spark, SF)), capsys)
    assert "lineitem.parquet" in p and "orders.parquet" in p
    assert "part.parquet" not in p and "supplier.parquet" not in p
    # column pruning: lineitem scan reads only the three columns it needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


def test_per_section_top_n_limits_before_shuffle(spark, capsys):
    p = plan(sales.top_performers(testbed.sales(spark, SF)), capsys)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_recent_list_is_take_ordered(spark, capsys):
    p = plan(supply_chain.recent_orders(testbed.supply_chain(spark, SF)), capsys)
    assert "TakeOrderedAndProject" in p


def test_global_comparisons_are_subqueries_not_cross_joins(spark, capsys):
    p = plan(hr.training_recommendations(testbed.hr(spark, SF)), capsys)
    assert "Subquery" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_order_grain_sums_lines_before_the_join(spark, capsys, no_auto_broadcast):
    p = plan(testbed.transport(spark, SF).frame("deliveries", "delivery_time"), capsys)
    assert p.count("lineitem.parquet") == 1                  # one scan, no sampling pass
    tree = p[:p.index("(1)")]
    join, scan = tree.index("SortMergeJoin"), tree.index("Scan parquet")
    assert "HashAggregate" in tree[join:scan]                # lines are summed below the join
    assert "partial_count" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("make", [lambda s: supply_chain.distributions(testbed.supply_chain(s, SF)),
                                  lambda s: sales.top_performers(testbed.sales(s, SF)),
                                  lambda s: production.performance(testbed.production(s, SF))])
def test_the_fact_is_summed_before_it_meets_dimensions(spark, capsys, no_auto_broadcast, make):
    p = plan(make(spark), capsys)
    assert p.count("lineitem.parquet") == 1
    assert "hashpartitioning(l_partkey" not in p and "hashpartitioning(l_suppkey" not in p
    assert "hashpartitioning(l_orderkey" not in p


@pytest.mark.parametrize("make, dims", [(lambda s: supply_chain.recent_orders(testbed.supply_chain(s, SF)), ("part", "supplier")),
                                        (lambda s: sales.recent_sales(testbed.sales(s, SF)), ("part", "customer")),
                                        (lambda s: production.recent_operations(testbed.production(s, SF)), ("part",))])
def test_recent_rows_are_picked_before_the_dimension_joins(spark, capsys, make, dims):
    p = plan(make(spark), capsys)
    tree = p[:p.index("(1)")]
    pick = tree.index("TakeOrderedAndProject")
    assert pick > tree.index("Join")          # the tree is printed from the top: joins above the pick
