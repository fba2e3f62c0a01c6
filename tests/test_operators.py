"""Unit and property tests for generic operators (brute force = pandas/numpy)."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiforge.functions import file_extension, ladder, parse_number, rate, recode, safe_name, signed_pct
from kpiforge.functions.dates import days_between, month_bucket, parse_dmy, weekday_mon0
from kpiforge.operators import aggregate as A
from kpiforge.operators import topk
from kpiforge.operators.derive import flag_low_high, scope_to, yes_no_to_int


def test_value_counts_drops_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    got = {r["key"]: r["n"] for r in A.value_counts(df, "k").collect()}
    assert got == {"a": 2, "b": 1}


def test_value_counts_multi_one_pass(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", None)], "k string, j int")
    got = {(r["section"], r["key"]): r["n"]
           for r in A.value_counts_multi(df, {"k": "k", "j": "j"}).collect()}
    assert got == {("k", "a"): 2, ("k", "b"): 1, ("j", "1"): 2}


def test_arg_max_first_key_among_ties(spark):
    df = spark.createDataFrame([("b", 3.0), ("a", 3.0), ("c", 1.0)], "k string, v double")
    assert A.arg_max(df, "k", "v").first()["k"] == "a"


def test_rate_counts_null_as_false(spark):
    df = spark.createDataFrame([(0.5,), (None,), (2.0,), (1.0,)], "h double")
    assert df.agg(rate(F.col("h") <= 1).alias("r")).first()["r"] == 50.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False), min_size=1,
                max_size=40))
def test_mean_above_median_matches_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = A.mean_above_median(df, "x").first()["above_median"]
    assert got == bool(np.mean(xs) > np.median(xs))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]),
                          st.integers(min_value=-100, max_value=100)), min_size=1, max_size=30))
def test_group_sums_add_up_and_counts_sum_to_n(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    groups = A.group_sum(df, "k", "v", "t").collect()
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    assert sum(r["t"] for r in groups) == pdf.dropna(subset=["k"])["v"].sum()
    counts = A.value_counts(df, "k").collect()
    assert sum(r["n"] for r in counts) == pdf["k"].notna().sum()
    r = df.agg(rate(F.col("v") > 0).alias("r")).first()["r"]
    assert 0.0 <= r <= 100.0


def test_repartition_does_not_change_results(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"),
                                  (F.col("id") * 0.5).alias("v"))
    a = sorted(A.group_agg_multi(df, {"k": "k"}, {"s": F.round(F.sum("v"), 2)}, ["v"]).collect())
    b = sorted(A.group_agg_multi(df.repartition(13), {"k": "k"}, {"s": F.round(F.sum("v"), 2)},
                                 ["v"]).collect())
    assert a == b


def test_top_per_section_and_recent(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("s", "c", 3.0),
                                ("t", "x", 2.0)], "section string, key string, v double")
    got = [(r["section"], r["key"], r["rank"]) for r in
           topk.top_per_section(df, "v", 2).orderBy("section", "rank").collect()]
    assert got == [("s", "b", 1), ("s", "c", 2), ("t", "x", 1)]
    d = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-03"), (3, "2024-01-03")],
                              "id int, d string").withColumn("d", F.to_date("d"))
    assert [r["id"] for r in topk.recent(d, "d", 2, tie=["id"]).collect()] == [2, 3]
    assert [r["id"] for r in topk.last_n(d, "id", 1).collect()] == [3]


def test_flag_low_high_uses_global_means(spark):
    df = spark.createDataFrame([(1, 10), (2, 0), (3, 20), (4, 30)], "p int, leave int")
    flagged = flag_low_high(df, "p", "leave", "f").where("f").collect()
    # mean p = 2.5, mean leave = 15 -> p < 2.5 and leave > 15: none; p=1 leave=10 no
    assert flagged == []
    df2 = spark.createDataFrame([(1, 40), (5, 0), (3, 20)], "p int, leave int")
    assert [r["p"] for r in flag_low_high(df2, "p", "leave", "f").where("f").collect()] == [1]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Yes", "Report.CSV", "$1,200", "Fuel (L/week)", "2024-02-14",
                                 "15/03/2019")],
                               "r string, f string, m string, n string, d string, h string")
    row = df.select(
        yes_no_to_int("r").alias("yn"), recode("r", {"No": 0}).alias("rc"),
        file_extension("f").alias("ext"), parse_number("m").alias("num"),
        safe_name("n").alias("safe"), ladder("r", {"Yes": "ok"}, "x").alias("badge"),
        signed_pct(F.lit(12.5)).alias("sp"), signed_pct(F.lit(-3.0)).alias("sn"),
        month_bucket(F.to_date("d"), "year_month").alias("ym"),
        month_bucket(F.to_date("d"), "month_of_year").alias("moy"),
        weekday_mon0(F.to_date("d")).alias("wd"),
        days_between(F.to_date("d"), F.to_date(F.lit("2024-02-20"))).alias("dd"),
        parse_dmy("h").alias("hired")).first()
    assert (row.yn, row.rc, row.ext, row.num, row.safe, row.badge) == \
        (1, None, "csv", 1200.0, "fuel_l_week", "ok")
    assert (row.sp, row.sn, row.ym, row.moy, row.wd, row.dd) == \
        ("+12.5%", "-3.0%", "2024-02", 2, 2, -6)
    assert str(row.hired) == "2019-03-15"


def test_scope_to(spark):
    df = spark.createDataFrame([("hr",), ("it",)], "department string")
    assert scope_to(df, "hr", False).count() == 1
    assert scope_to(df, "hr", True).count() == 2


def test_projection_helpers_and_logs_join(spark):
    from kpiforge.functions.dates import iso_or_null
    from kpiforge.operators.derive import cast_columns, drop_columns, project
    from kpiforge.operators.joins import logs_with_users
    df = spark.createDataFrame([(1, "7", None)], "id int, n string, ts timestamp")
    out = cast_columns(drop_columns(df, ["ts"]), {"n": "int"})
    assert out.dtypes == [("id", "int"), ("n", "int")]
    assert project(out, ["n"]).columns == ["n"]
    assert df.select(iso_or_null("ts").alias("iso")).first().iso is None
    logs = spark.createDataFrame([(1, "login"), (2, "upload"), (None, "anon")],
                                 "user_id int, action string")
    users = spark.createDataFrame([(1, "a@x")], "id int, email string")
    rows = {r.action: r.email for r in logs_with_users(logs, users).collect()}
    assert rows == {"login": "a@x", "upload": None, "anon": None}
