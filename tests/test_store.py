"""Model store: fit once, reuse, refit on change, crash before the commit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.ml import coreset, forest
from kpiforge.ml.store import ModelStore


def _rows(spark):
    return spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3.0).alias("y"))


def _fit(df, calls):
    def fit():
        calls.append(1)
        return forest.pipeline(["x"], [], forest.regressor("y", num_trees=5, max_depth=3)).fit(df)
    return fit


def test_a_model_is_fitted_once_and_scores_alike_after_loading(spark, tmp_path):
    df, calls, store = _rows(spark), [], ModelStore(spark, str(tmp_path))
    a, reused_a = store.fit_once("m", df, {"seed": 1}, _fit(df, calls))
    b, reused_b = store.fit_once("m", df.repartition(5).orderBy(F.desc("id")), {"seed": 1}, _fit(df, calls))
    assert (reused_a, reused_b, len(calls), store.log().count()) == (False, True, 1, 1)
    score = lambda m: [r.prediction for r in forest.score(m, df, ["id"]).orderBy("id").collect()]
    assert score(a) == score(b)
    one = forest.score(b, df.where("id = 4"), ["id"]).collect()   # ML16: a single row
    assert len(one) == 1 and one[0].prediction == score(a)[4]


@pytest.mark.parametrize("change", ["name", "params", "row changed", "row missing", "row twice", "null", "column name", "type"])
def test_any_change_of_what_is_fitted_gives_another_key(spark, change):
    df = _rows(spark)
    name, params, other = "m", {"seed": 1}, df
    if change == "name":
        name = "n"
    elif change == "params":
        params = {"seed": 2}
    elif change == "row changed":
        other = df.withColumn("x", F.when(F.col("id") == 17, 99.0).otherwise(F.col("x")))
    elif change == "row missing":
        other = df.where("id != 17")
    elif change == "row twice":
        other = df.union(df.where("id = 17"))
    elif change == "null":
        other = df.withColumn("x", F.when(F.col("id") != 17, F.col("x")))
    elif change == "column name":
        other = df.withColumnRenamed("x", "z")
    else:
        other = df.withColumn("x", F.col("x").cast("float"))
    assert ModelStore.key(name, other, params) != ModelStore.key("m", df, {"seed": 1})


def test_a_run_that_dies_before_the_commit_leaves_nothing_visible(spark, tmp_path):
    df, calls, store = _rows(spark), [], ModelStore(spark, str(tmp_path))

    def dies(model, path):
        model.write().save(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.fit_once("m", df, {}, _fit(df, calls), save=dies)
    assert store.log().count() == 0
    assert store.fit_once("m", df, {}, _fit(df, calls))[1] is False and len(calls) == 2
    assert store.fit_once("m", df, {}, _fit(df, calls))[1] is True


def test_of_two_commits_of_a_key_all_readers_load_the_first(spark, tmp_path):
    store, df = ModelStore(spark, str(tmp_path)), _rows(spark)
    late = {2: np.array([[9.0, 9.0]])}

    def races():   # another job commits the same key while this one fits
        ModelStore(spark, str(tmp_path)).fit_once("c", df, {}, lambda: {2: np.array([[1.0, 2.0], [3.0, 4.0]])},
                                                  coreset.save_centres, coreset.load_centres)
        return late

    got, reused = store.fit_once("c", df, {}, races, coreset.save_centres, coreset.load_centres)
    assert not reused and got[2].tolist() == [[1.0, 2.0], [3.0, 4.0]] and store.log().count() == 2


def test_empty_tables_have_a_key(spark, tmp_path):
    none = _rows(spark).where("id < 0")
    got, _ = ModelStore(spark, str(tmp_path)).fit_once("c", none, {}, lambda: {}, coreset.save_centres, coreset.load_centres)
    assert got == {}
