"""Random search with cross-validation (ML8)."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder


def sampled_grid(estimator, grid: Mapping[str, Sequence], n_iter: int = 4, seed: int = 42):
    """``n_iter`` random points of the full grid (RandomizedSearchCV's sampling)."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    rng = random.Random(seed)
    return rng.sample(maps, min(n_iter, len(maps)))


def random_search(pipeline: Pipeline, estimator, grid: Mapping[str, Sequence], label: str,
                  task: str = "classification", n_iter: int = 4, folds: int = 3,
                  seed: int = 42, fold_col: str | None = None) -> CrossValidator:
    """A CrossValidator over sampled param maps (accuracy or r2).

    ``fold_col``: each row's fold (0 to folds - 1), so that a repeated task
    puts its rows into the same folds.
    """
    if task == "classification":
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    else:
        ev = RegressionEvaluator(labelCol=label, metricName="r2")
    extra = {"foldCol": fold_col} if fold_col else {}
    return CrossValidator(**extra, estimator=pipeline,
                          estimatorParamMaps=sampled_grid(estimator, grid, n_iter, seed),
                          evaluator=ev, numFolds=folds, parallelism=4, seed=seed)

