"""Neighbours along space-filling curves, and oversampling from them, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from kpiforge.ml import neighbours
from kpiforge.ml.neighbours import nearest_rows
from kpiforge.ml.oversample import oversample


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1]))).repartition(5)


def brute(x, k=5):
    ids = np.array([str(i) for i in range(len(x))])
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[ids[i]] = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


def test_small_tables_are_exact_with_ties(spark):
    x = np.random.default_rng(1).integers(0, 4, size=(300, 3)).astype(float)
    got = {r.id: [(n.d, n.id) for n in r.near] for r in nearest_rows(frame(spark, x), "id", ["c0", "c1", "c2"]).collect()}
    want = brute(x)
    assert got.keys() == want.keys() and all(np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]]) and [j for _, j in got[i]] == [j for _, j in want[i]] for i in got)


def test_recall_of_many_buckets(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(4_000, 5)), rng.normal(size=(2_000, 5)) * 0.1 + 2])
    cols = [f"c{j}" for j in range(5)]
    got = nearest_rows(frame(spark, x), "id", cols, half=128).collect()
    want = brute(x)
    hits = sum(len({n.id for n in r.near} & {j for _, j in want[r.id]}) for r in got)
    assert len(got) == len(x) and hits >= 0.9 * 5 * len(x)
    for r in got[:200]:
        for n in r.near:
            assert np.isclose(n.d, np.linalg.norm(np.array(r.v) - np.array(n.v)))


def test_missing_values_and_lone_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id long, c0 double")
    got = nearest_rows(df, "id", ["c0"]).collect()
    assert [r.id for r in got] == ["1"] and not got[0].near
    assert nearest_rows(df.limit(0), "id", ["c0"]).count() == 0


def test_every_minority_row_is_a_base(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HALF", 64)
    rng = np.random.default_rng(3)
    n = 3_000
    y = (rng.random(n) < 0.2).astype(int)
    x = rng.normal(size=(n, 2)) + y[:, None]
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)], "k int, y int, a double, b double")
    out = oversample(df, "k", "y", ["a", "b"]).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum()
    made = out[out.k.str.startswith("synthetic-")]
    small = x[y == 1]
    bases = set()
    order = sorted(str(i) for i in range(n) if y[i])
    for key, a, b in made[["k", "a", "b"]].itertuples(index=False):
        bases.add(order[int(key.split("-")[1]) % len(order)])
        base = x[int(order[int(key.split("-")[1]) % len(order)])]
        to, at = small - base, np.array([a, b]) - base
        t = np.clip((to @ at) / np.maximum((to ** 2).sum(axis=1), 1e-12), 0, 1)
        assert np.linalg.norm(t[:, None] * to - at, axis=1).min() < 1e-9
    assert bases == set(order)


def test_one_minority_row_is_repeated(spark):
    df = spark.createDataFrame([(i, int(i == 0), float(i)) for i in range(6)], "k int, y int, a double")
    out = oversample(df, "k", "y", ["a"]).where("y = 1")
    assert out.count() == 5 and out.select("a").distinct().count() == 1
    assert oversample(df.where("y = 0"), "k", "y", ["a"]).count() == 5
    assert oversample(df.withColumn("a", F.when(F.col("y") == 0, F.col("a"))), "k", "y", ["a"]).count() == 6
