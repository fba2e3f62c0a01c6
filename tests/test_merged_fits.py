"""Fits, scores and silhouettes over many rows: work follows from distinct features, results are those of all rows."""

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from kpiforge.ml import forest
from kpiforge.ml.metrics import regression_metrics
from kpiforge.ml.silhouette import scores, squares


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(6000).select(i.alias("rid"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000).alias("x"), (i % 7).alias("m"),
                                  F.when(i % 11 != 0, F.concat(F.lit("c"), (i % 3).cast("string"))).alias("c"))
    df = df.withColumn("y", 10 * F.col("x") + F.col("m") + F.when(F.col("c") == "c1", 5.0).otherwise(0.0))
    return df.withColumn("late", (F.col("y") > 10).cast("double"))


def fitted(rows, whole, label="y", make=forest.regressor):
    return forest.fit(rows, "rid", label, ["x", "m"], ["c"], make(label, num_trees=20, max_depth=6), whole_rows=whole)


def test_merged_blocks_hold_every_row(rows):
    cut = forest.bins(rows, ["x", "m"])
    assert cut.getInputCols() == ["x"] and len(cut.getSplitsArray()[0]) == forest.BINS + 1
    binned = cut.transform(rows)
    for blocks in (1, 3):
        out = forest.merged(binned, "rid", "y", ["x_bin", "m", "c"], blocks, False, 42).toPandas()
        cells = binned.select("x_bin", "m", "c").distinct().count()
        assert cells <= len(out) <= cells * blocks and out._weight.sum() == 6000
        assert np.isclose((out.y * out._weight).sum(), rows.agg(F.sum("y")).first()[0])
    by = forest.merged(binned, "rid", "late", ["x_bin", "m", "c"], 1, True, 42).toPandas()
    assert set(by.late) == {0.0, 1.0} and by._weight.sum() == 6000


def test_merged_forest_is_as_good_as_one_of_all_rows(rows):
    whole, some = fitted(rows, 10_000), fitted(rows, 1_000)
    assert not isinstance(whole.stages[0], Bucketizer) and isinstance(some.stages[0], Bucketizer)
    r2 = [regression_metrics(m.transform(rows), "y").first().r2 for m in (whole, some)]
    assert r2[1] > 0.95 and abs(r2[0] - r2[1]) < 0.02
    cls = fitted(rows, 1_000, "late", forest.classifier).transform(rows)
    assert cls.agg(F.avg((F.col("late") == F.col("prediction")).cast("double"))).first()[0] > 0.9


def test_equal_features_are_scored_once_and_rows_get_the_same(rows, spark, tmp_path):
    model = fitted(rows, 1_000)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = type(model).load(str(tmp_path / "model"))
    want = {r.rid: r.prediction for r in model.transform(rows).select("rid", "prediction").collect()}
    got = forest.predicted(loaded, rows, whole_rows=1_000)
    assert got.columns == [*rows.columns, "prediction"]
    assert "HashJoin" in got._jdf.queryExecution().toString()   # scored by distinct features, not by row
    found = {r.rid: r.prediction for r in got.collect()}
    assert found == want


def test_features_that_hardly_repeat_are_fitted_row_by_row(spark):
    df = spark.range(2000).select(F.col("id").alias("rid"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("d"), F.rand(4).alias("y"))
    model = forest.fit(df, "rid", "y", ["a", "b", "d"], [], forest.regressor("y", num_trees=3, max_depth=3), whole_rows=500)
    assert not isinstance(model.stages[0], Bucketizer)
    assert forest.predicted(model, df, whole_rows=500).where("prediction IS NOT NULL").count() == 2000


def test_a_null_label_is_refused_by_both_ways(rows):
    bad = rows.withColumn("y", F.when(F.col("rid") != 5, F.col("y")))
    for whole in (10_000, 1_000):
        with pytest.raises(Exception, match="(?i)label"):
            fitted(bad, whole)


def test_squared_distances_equal_differences():
    rng = np.random.default_rng(1)
    ref = np.r_[rng.normal(size=(300, 4)) + 1000, rng.normal(size=(50, 4)) * 1e-4]
    x = np.r_[ref[:20], rng.normal(size=(30, 4))]
    want = ((x[:, None] - ref[None]) ** 2).sum(axis=2)
    got = squares(x, ref)
    assert np.allclose(got, want, rtol=1e-8, atol=0) and (np.diag(got[:20, :20]) == 0).all()


def test_groups_of_equal_rows_have_exact_scores():
    ref = np.repeat([[0.1, 0.2], [0.1, 0.2], [3.1, 4.2]], 40, axis=0)
    own = np.repeat([0, 1, 2], 40)
    s, _ = scores(ref, own, np.ones(120, bool), ref, np.full(3, 40), np.full(3, 40))
    assert (s[:80] == 0).all() and (s[80:] == 1).all()
