"""Joins and grains that several sections read are stored once, with the same rows."""

import pytest
from pyspark.sql import functions as F

from kpiforge.plans import summary
from kpiforge.sources import testbed
from kpiforge.sources.binding import Dim, Role, StarSource

TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
                 [(i % 9, i % 5, i % 4, i, float(i % 3), 10.0 * i, 0.1, 0.05, "RAN"[i % 3], "OF"[i % 2], f"1996-0{1 + i % 3}-1{i % 9}") for i in range(40)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
               [(i, i % 4, "FO"[i % 2], 5.0 * i, f"1996-01-0{1 + i % 8}", f"{i % 3}-LEVEL") for i in range(8)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(i, f"c{i}", i % 2, 10.0 - 7 * i, "AB"[i % 2]) for i in range(4)]),
    "part": ("p_partkey long, p_name string, p_type string", [(i, f"part {i % 3}", "XY"[i % 2]) for i in range(5)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(i, f"s{i}", 0) for i in range(3)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 1)]),
    "region": ("r_regionkey int, r_name string", [(0, "R0"), (1, "R1")]),
    "events": ("event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string",
               [(i, i % 4, "ab"[i % 2], float(i), f"1996-01-0{1 + i % 9}", f'{{"k": {i}}}') for i in range(12)]),
}


@pytest.fixture
def tables(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        fields = [f.strip().split(" ") for f in schema.split(",")]
        read = ", ".join(f"{c} {'string' if t == 'timestamp_ntz' else t}" for c, t in fields)
        spark.createDataFrame(rows, read).select(*[F.col(c).cast(t) for c, t in fields]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def counted(monkeypatch) -> list:
    asked = []

    class Counting(testbed.Tables):
        def __call__(self, name):
            asked.append(name)
            return super().__call__(name)

    monkeypatch.setattr(testbed, "Tables", Counting)
    return asked


def lines(df):
    return sorted(map(str, df.collect()))


def test_documents_join_lines_with_orders_once(spark, tables, monkeypatch):
    asked = counted(monkeypatch)
    assert summary.documents(spark, tables).count() > 0
    assert asked.count("orders") == 1


def test_all_departments_join_and_sum_orders_once(spark, tables, monkeypatch):
    want = {d: lines(summary.build_summary(d, testbed.SOURCES[d](spark, tables))) for d in summary.DEPARTMENTS}
    sources = testbed.stored_sources(spark, tables, summary.DEPARTMENTS)
    assert {d: lines(summary.build_summary(d, src)) for d, src in sources.items()} == want
    asked = counted(monkeypatch)
    assert summary.section_sizes(spark, tables).count() > 0
    assert asked.count("orders") == 3   # lines with orders, the order grain, campaigns


def star(spark) -> StarSource:
    """Dimension keys that come twice, lack or are null, two hops."""
    fact = spark.createDataFrame([(k, f"own{i % 2}", float(i)) for i, k in enumerate([1, 1, 2, 3, None, 7, 2, 5])], "fk long, own string, x double")
    mid = spark.createDataFrame([(1, 10, "2024-01-01"), (2, 11, "2024-01-02"), (2, 10, "2024-01-03"), (3, None, None), (None, 10, "2024-02-01")],
                                "m_id long, m_to long, m_day string")
    far = spark.createDataFrame([(10, "ten"), (10, "also ten"), (11, None)], "f_id long, f_name string")
    return StarSource(lambda: fact, {"mid": Dim(lambda: mid, [("fk", "m_id")]), "far": Dim(lambda: far, [("m_to", "f_id")], ("mid",))},
                      {"own": Role(F.col("own")), "x": Role(F.col("x")), "day": Role(F.col("m_day"), ("mid",)), "far": Role(F.col("f_name"), ("far",))})


def test_a_stored_join_gives_the_same_rows(spark):
    src = star(spark)
    stored = src.stored(["mid"], ["fk", "own", "x", "m_to", "m_day"], "star")
    for roles in (["x"], ["own", "x"], ["x", "day"], ["far", "x", "day"]):
        assert lines(stored.frame(*roles)) == lines(src.frame(*roles))
    sums = {"n": F.count("*"), "s": F.sum("x")}
    for sections in ({"o": "own"}, {"o": "own", "d": "day"}, {"f": "far", "o": "own"}, {"f": "far", "d": "day"}):
        for reads in (["x"], ["x", "day"]):
            assert lines(stored.keyed_sums(sections, sums, reads)) == lines(src.keyed_sums(sections, sums, reads))
    assert lines(stored.latest("day", 3, ["day", "x", "far"], keys=["x"])) == lines(src.latest("day", 3, ["day", "x", "far"], keys=["x"]))
