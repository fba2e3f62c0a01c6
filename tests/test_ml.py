"""ML mechanics: split, scaling, encoding, metrics (brute force with numpy)."""

import numpy as np
from pyspark.sql import functions as F

from kpiforge.ml import cluster, forest
from kpiforge.ml.metrics import classification_report, regression_metrics
from kpiforge.ml.prepare import label_encode, zscore
from kpiforge.ml.split import train_test


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    tr, te = train_test(df, "k")
    a = {r.k for r in tr.collect()}
    b = {r.k for r in te.collect()}
    assert not (a & b) and len(a | b) == 5000
    assert 0.75 < len(a) / 5000 < 0.85
    tr2, _ = train_test(df.repartition(7), "k")
    assert {r.k for r in tr2.collect()} == a


def test_zscore_population_std(spark):
    xs = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.z_x for r in zscore(df, ["x"]).orderBy("x").collect()]
    exp = (np.array(xs) - np.mean(xs)) / np.std(xs)
    assert np.allclose(got, exp)


def test_label_encode_sorted_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "p string")
    got = {r.p: r.p_code for r in label_encode(df, ["p"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_regression_metrics(spark):
    a = np.array([1.0, 2.0, 3.0, 4.0])
    p = np.array([1.5, 2.0, 2.0, 5.0])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "label double, prediction double")
    m = regression_metrics(df).first()
    assert np.isclose(m.mse, np.mean((a - p) ** 2))
    assert np.isclose(m.r2, 1 - np.sum((a - p) ** 2) / np.sum((a - a.mean()) ** 2))


def test_classification_report_matches_counts(spark):
    # golden confusion 00:11 01:12 10:10 11:8 -> accuracy 19/41
    rows = [(0, 0)] * 11 + [(0, 1)] * 12 + [(1, 0)] * 10 + [(1, 1)] * 8
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r.cls: r for r in classification_report(df).collect()}
    assert np.isclose(rep["accuracy"].precision, 19 / 41)
    assert np.isclose(rep["1"].precision, 8 / 20) and np.isclose(rep["1"].recall, 8 / 18)
    assert rep["0"].support == 23 and rep["macro avg"].support == 41


def test_forest_and_kmeans_shapes(spark):
    df = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 10).alias("x"),
                                 (F.col("id") % 3).cast("string").alias("c"),
                                 ((F.col("id") % 10) * 2.0).alias("y"))
    model, m = forest.fit_evaluate_regression(df, "rid", "y", ["x"], ["c"], num_trees=10,
                                              max_depth=4)
    row = m.first()
    assert row.n > 0 and row.r2 > 0.9
    scored = forest.score(model, df, ["rid"])
    assert scored.count() == 400
    data = cluster.assemble(df, ["x", "y"])
    km = cluster.kmeans(data, 2, seeds=(1, 2))
    counts = cluster.cluster_counts(km, data).collect()
    assert sum(r.n for r in counts) == 400 and len(counts) == 2


def test_oversampling_balances_between_minority_rows(spark):
    from kpiforge.ml.oversample import oversample
    rows = [(i, int(i % 10 == 0), float(i % 7), float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    out = oversample(df, "k", "y", ["a", "b"]).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 270
    made = out[out.k.str.startswith("synthetic-")][["a", "b"]].to_numpy()
    small = np.array([r[2:] for r in rows if r[1]])
    for x in made:   # on a segment between two minority rows
        d = small[:, None, :] - small[None]
        t = ((x - small[None]) * d).sum(2) / np.maximum((d ** 2).sum(2), 1e-12)
        near = np.linalg.norm(small[None] + np.clip(t, 0, 1)[..., None] * d - x, axis=2)
        assert near.min() < 1e-9
    again = oversample(df.repartition(5), "k", "y", ["a", "b"]).toPandas()
    assert np.allclose(np.sort(made, axis=0), np.sort(again[again.k.str.startswith("synthetic-")][["a", "b"]].to_numpy(), axis=0))


def test_cluster_counts_cover_invalid_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 6.0), (None, 1.0)], "x double, y double")
    data = cluster.assemble(df, ["x", "y"])
    counts = {r.cluster: r.n for r in cluster.cluster_counts(cluster.kmeans(data, 2, (1,)), data, df, ["x", "y"]).collect()}
    assert sum(counts.values()) == 3 and counts[cluster.INVALID] == 1
