"""Exact order statistics, ranks and dictionaries against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.ml.prepare import label_encode
from kpiforge.operators import quantiles
from kpiforge.operators.quantiles import exact_quantiles
from kpiforge.operators.rank import global_rank


def values(kind, n, rng):
    return {"uniform": lambda: [rng.random() for _ in range(n)],
            "ties": lambda: [float(rng.randrange(3)) for _ in range(n)],
            "one": lambda: [7.0] * n,
            "wide": lambda: [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
            "infinite": lambda: [rng.choice([float("inf"), -float("inf"), 0.0, 1.5]) for _ in range(n)]}[kind]()


@pytest.mark.parametrize("kind", ["uniform", "ties", "one", "wide", "infinite"])
def test_quantiles_equal_numpy(spark, kind, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 20)   # several passes
    rng = random.Random(3)
    data = {g: values(kind, n, rng) for g, n in [("a", 1), ("b", 2), ("c", 21), ("d", 400), ("e", 3_000)]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("f", None), (None, 1.0), ("b", float("nan"))]
    rng.shuffle(rows)
    qs = (0.0, 0.1, 0.5, 1.0)
    got = {(r.g, r.q): (r.n, r.quantile) for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", qs).collect()}
    assert got.keys() == {(g, q) for g in data for q in qs}
    for (g, q), (n, x) in got.items():
        vs, at = sorted(data[g]), q * (len(data[g]) - 1)
        lo, hi = vs[int(np.floor(at))], vs[int(np.ceil(at))]
        want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
        assert n == len(vs) and (x == pytest.approx(want, rel=1e-12) or (np.isnan(want) and np.isnan(x)) or (lo == hi and np.isinf(lo)))


def test_quantiles_store_only_rows_still_in_question(spark, monkeypatch):
    stored = []

    def recorded(df, name, keep=quantiles.staged):
        out = keep(df, name)
        if "v" in out.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "staged", recorded)
    monkeypatch.setattr(quantiles, "FEW", 20, raising=False)
    monkeypatch.setattr(quantiles, "SAMPLE", 400, raising=False)
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    want = {(g, q): float(np.quantile(sorted(i * 7919 % 30_011 for i in range(g, 30_000, 2)), q)) for g in (0, 1) for q in (0.25, 0.5)}
    assert {(r.g, r.q): r.quantile for r in exact_quantiles(df, ["g"], "v", (0.25, 0.5)).collect()} == want
    assert len(stored) > 3 and stored[2] < stored[0] / 2 and stored[3] < stored[2] / 2   # all rows, all of large groups, those in ranges


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(1_001).select(F.col("id").cast("double").alias("v"))
    assert [(r.n, r.quantile) for r in exact_quantiles(df, [], "v").collect()] == [(1_001, 500.0)]
    assert exact_quantiles(df.limit(0), [], "v").count() == 0


def test_global_rank_is_the_sorted_place(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("x")).repartition(9)
    got = {r.x: r.place for r in global_rank(df, ["x"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))}
    same = global_rank(spark.range(300).select(F.lit(1).alias("x")), ["x"])
    assert sorted(r.place for r in same.collect()) == list(range(300))


def test_codes_of_many_labels_and_nulls(spark):
    labels = [f"label {i * 37 % 2_000:04d}" for i in range(2_000)]
    rows = [(s,) for s in labels + labels[:50]] + [(None,)]
    got = label_encode(spark.createDataFrame(rows, "p string"), ["p"]).collect()
    place = {s: i for i, s in enumerate(sorted(labels))}
    assert len(got) == len(rows) and all(r.p_code == place.get(r.p, 2_000) for r in got)
