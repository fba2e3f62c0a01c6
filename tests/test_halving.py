"""Successive halving: rungs, folds, choice, ties, nulls."""

import numpy as np
from pyspark.sql import functions as F

from kpiforge.ml import halving


def _rows(spark, n=3000):
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0) - 0.5
    return spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"),
                                 ((F.col("id") % 10) * 2.0 + noise).alias("y"), ((F.col("id") % 10) >= 5).cast("int").alias("b"))


def _shifted(candidate, share, fitted, scored):
    return scored.withColumn("prediction", F.col("label") + candidate["by"])


def test_folds_and_rungs_depend_on_the_id_only_and_rungs_grow(spark):
    a = halving.dealt(_rows(spark), "rid").select("rid", "fold", "part").toPandas().sort_values("rid")
    b = halving.dealt(_rows(spark).repartition(9).orderBy(F.desc("x")), "rid").select("rid", "fold", "part").toPandas().sort_values("rid")
    assert a.to_numpy().tolist() == b.to_numpy().tolist()
    assert set(a.fold) == {0, 1, 2} and a.fold.value_counts().min() > 800
    shares = [len(a[a.part < s * halving.PARTS]) / len(a) for s in halving.RUNGS]
    assert abs(shares[0] - 0.25) < 0.04 and abs(shares[1] - 0.5) < 0.04 and shares[2] == 1


def test_the_smallest_error_wins_and_half_goes_on(spark):
    rows = halving.dealt(_rows(spark).withColumn("label", F.col("y")), "rid")
    best, table = halving.search(rows, [{"by": v} for v in (4.0, 1.0, 0.5, 3.0, 2.0)], _shifted, "regression")
    got = table.collect()
    assert best == 2
    assert [(r.candidate, r.kept) for r in got if r.rung == 0] == [(0, False), (1, True), (2, True), (3, False), (4, True)]
    assert [(r.candidate, r.kept) for r in got if r.rung == 1] == [(1, True), (2, True), (4, False)]
    assert [(r.candidate, r.kept) for r in got if r.rung == 2] == [(1, False), (2, True)]
    pdf = rows.toPandas()
    for r in got:
        used = pdf[pdf.part < r.share * halving.PARTS]
        by = (4.0, 1.0, 0.5, 3.0, 2.0)[r.candidate]
        r2 = [1 - by ** 2 / np.var(g.label) for _, g in used.groupby("fold")]
        assert abs(r.score - np.mean(r2)) < 1e-9


def test_ties_go_by_order_and_undefined_scores_come_last(spark):
    rows = halving.dealt(_rows(spark, 300).withColumn("label", F.col("b").cast("double")), "rid")
    same = lambda c, share, fitted, scored: scored.withColumn("prediction", F.lit(c["p"]))
    assert halving.search(rows, [{"p": 7.0}, {"p": 1.0}, {"p": 1.0}], same, "classification")[0] == 1
    flat = rows.withColumn("label", F.lit(3.0))
    best, table = halving.search(flat, [{"by": 0.0}, {"by": 1.0}], _shifted, "regression")
    assert best == 0 and all(r.score is None for r in table.collect())
    nulls = rows.withColumn("label", F.when(F.col("rid") % 2 == 0, F.col("label")))
    assert halving.search(nulls, [{"by": 1.0}, {"by": 0.0}], _shifted, "classification")[0] == 1
    assert halving.search(rows.where("rid < 0"), [{"by": 1.0}, {"by": 0.0}], _shifted, "classification")[0] == 0


def test_forests_are_searched_for_both_tasks(spark):
    grid = [{"num_trees": 4, "max_depth": d, "min_instances": 1} for d in (1, 4)]
    model, table = halving.forest_search(_rows(spark, 900), "rid", "y", ["x"], ["c"], grid)
    best = table.where("rung = 1 AND kept" if table.where("rung = 2").isEmpty() else "rung = 2 AND kept").first()
    assert "max_depth=4" in best.params and best.score > 0.95
    out = model.transform(_rows(spark, 900)).agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("e")).first()
    assert out.e < 0.6
    model, table = halving.forest_search(_rows(spark, 900), "rid", "b", ["x"], ["c"], grid, task="classification")
    assert table.where("rung = 2").first().score == 1.0
    assert model.transform(_rows(spark, 900)).where("prediction != b").count() == 0
