"""Core-set k-means and Euclidean silhouettes against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.ml import cluster, coreset
from kpiforge.ml.silhouette import silhouettes


def blobs(n, seed=1, d=3, k=4):
    rng = np.random.default_rng(seed)
    which = rng.integers(0, k, n)
    return rng.normal(size=(k, d))[which] * 6 + rng.normal(size=(n, d)), which


def frame(spark, x, labels=None):
    rows = [(i, *map(float, r), None if labels is None else str(labels[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1])) + ", label string").repartition(4)


def cost(x, centres):
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_core_set_fit_costs_as_little_as_fits_on_all_rows(spark):
    x, _ = blobs(6_000)
    df, cols = frame(spark, x), ["c0", "c1", "c2"]
    got = coreset.fit(df, cols, ["id"], [2, 4], size=1_500)
    assert coreset.core_set(df, cols, ["id"], 1_500).count() < 2_000
    data = cluster.assemble(df, cols)
    for k in (2, 4):
        full = cluster.kmeans(data, k, (1, 2, 3))
        assert cost(x, got[k]) <= 1.02 * full.summary.trainingCost
    again = coreset.fit(df.repartition(7), cols, ["id"], [4], size=1_500)
    assert np.allclose(again[4], got[4])


def test_weights_estimate_the_cost_of_all_rows(spark):
    x, _ = blobs(5_000, seed=2)
    core = coreset.core_set(frame(spark, x), ["c0", "c1", "c2"], ["id"], 1_000).toPandas()
    centres = x[:3]
    d, w = coreset.nearest(core[["c0", "c1", "c2"]].to_numpy(), centres)[1], core["weight"].to_numpy()
    assert (d * w).sum() == pytest.approx(cost(x, centres), rel=0.08) and w.sum() == pytest.approx(5_000, rel=0.08)


def test_assignment_sizes_and_steps(spark):
    x, _ = blobs(500, seed=3, d=2)
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None, 1.0, None), (901, float("nan"), 1.0, None)], "id long, c0 double, c1 double, label string"))
    cols, centres = ["c0", "c1"], x[:3].copy()
    at = coreset.nearest(x, centres)[0]
    got = {r.id: r.cluster for r in coreset.assign(df, cols, centres).collect()}
    assert got[900] == got[901] == coreset.INVALID and [got[i] for i in range(500)] == at.tolist()
    n = {r.cluster: r.n for r in coreset.sizes(df, cols, centres).collect()}
    assert n == {coreset.INVALID: 2, **{k: int(v) for k, v in enumerate(np.bincount(at))}}
    assert np.allclose(coreset.lloyd_step(df, cols, centres), [x[at == k].mean(axis=0) for k in range(3)])


def test_fewer_points_than_centres_and_no_rows(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 2) for i in range(6)], "id long, c0 double")
    assert len(coreset.fit(df, ["c0"], ["id"], [5])[5]) == 2
    assert coreset.fit(df.limit(0), ["c0"], ["id"], [2]) == {}


def plain_silhouette(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
    for i, g in enumerate(labels):
        own = labels == g
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == h].mean() for h in set(labels) if h != g)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_is_exact_below_the_bound_and_close_beyond(spark):
    x, which = blobs(900, seed=4)
    which[0] = 9   # a group of one row
    df = frame(spark, x, which).withColumn("one", F.lit("same"))
    want = plain_silhouette(x, which)
    cols = ["c0", "c1", "c2"]
    exact = {r.labelling: r for r in silhouettes(df, cols, ["label", "one"], ["id"]).collect()}
    assert exact["label"].silhouette == pytest.approx(want, abs=1e-9) and exact["label"].error_bound == 0 and exact["label"].n == 900
    assert exact["one"].silhouette is None and exact["one"].groups == 1
    near = silhouettes(df, cols, ["label"], ["id"], exact_rows=500).first()
    assert 0 < near.error_bound < 0.2 and abs(near.silhouette - want) <= near.error_bound
