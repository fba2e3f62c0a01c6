"""Successive halving with folds fixed by hash (ML8), for classifiers (accuracy) and regressors (r2).

Every rung scores the candidates that are left by cross-validation, on a share of the rows and of the
trees that grows from rung to rung; the better half goes on. Rows of a rung and of a fold follow from
the row id alone, so a repeated task, or another partitioning, sees the same rows. All predictions of
a rung are scored in one aggregation; only one score per candidate comes back.

Defined cases: rows with a null label are neither fitted nor scored; a score that isn't defined (no
rows, or labels all equal) is below all others; equal scores go by the candidates' order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.ml import forest
from kpiforge.ml.prepare import one_hot_stages
from kpiforge.ml.split import hash_part
from kpiforge.staging import staged

FOLDS = 3
#: The share of rows, and of trees, at each rung; and by how much a rung thins the candidates out.
RUNGS = (0.25, 0.5, 1.0)
ETA = 2
PARTS = 10_000
RESULT = "rung int, candidate int, params string, share double, score double, kept boolean"


def dealt(df: DataFrame, id_col: str, seed: int = 42, folds: int = FOLDS) -> DataFrame:
    """``df`` with each row's ``fold``, and its ``part`` (0 to ``PARTS`` - 1) that decides from which rung on it takes part."""
    return df.withColumns({"fold": hash_part(id_col, seed + 1, folds).cast("int"), "part": hash_part(id_col, seed + 2, PARTS).cast("int")})


def at_rung(rows: DataFrame, share: float) -> DataFrame:
    return rows.where(F.col("part") < round(share * PARTS))


def scores(predictions: DataFrame, task: str) -> DataFrame:
    """(candidate, score): the mean over folds of r2 or accuracy. ``predictions``: candidate, fold, label, prediction."""
    if task == "regression":
        err = F.col("label") - F.col("prediction")
        sst = F.var_pop("label") * F.count("*")
        score = F.when(sst > 0, F.lit(1.0) - F.sum(err * err) / sst)
    else:
        score = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return predictions.groupBy("candidate", "fold").agg(score.alias("s")).groupBy("candidate").agg(F.avg("s").alias("score"))


def search(rows: DataFrame, candidates: Sequence[Mapping], fit_predict: Callable[[Mapping, float, DataFrame, DataFrame], DataFrame],
           task: str, folds: int = FOLDS, rungs: Sequence[float] = RUNGS, eta: int = ETA, parallelism: int = 4) -> tuple[int, DataFrame]:
    """(best candidate's place, one row per rung and candidate as ``RESULT``).

    ``rows``: ``dealt``, with ``label``. ``fit_predict(candidate, share, fitted, scored)`` gives
    ``scored`` with a ``prediction``; at most candidates x folds of them are asked for in a rung.
    """
    rows, alive, table = rows.where("label IS NOT NULL"), list(range(len(candidates))), []
    for rung, share in enumerate(rungs):
        used = at_rung(rows, share)

        @inheritable_thread_target(rows.sparkSession)
        def one(job: tuple[int, int]) -> DataFrame:
            c, f = job
            out = fit_predict(candidates[c], share, used.where(F.col("fold") != f), used.where(F.col("fold") == f))
            return out.select(F.lit(c).alias("candidate"), "fold", "label", "prediction")

        with ThreadPool(parallelism) as pool:
            parts = pool.map(one, [(c, f) for c in alive for f in range(folds)], chunksize=1)
        found = {r.candidate: r.score for r in scores(reduce(DataFrame.unionByName, parts), task).collect()}
        value = lambda c: -math.inf if found.get(c) is None else round(found[c], 9)
        ranked = sorted(alive, key=lambda c: (-value(c), c))
        left = ranked[:1 if rung == len(rungs) - 1 else math.ceil(len(ranked) / eta)]
        table += [(rung, c, ", ".join(f"{k}={v}" for k, v in sorted(candidates[c].items())), float(share), found.get(c), c in left)
                  for c in alive]
        alive = sorted(left)
    return alive[0], rows.sparkSession.createDataFrame(table, RESULT)


def staged_features(df: DataFrame, id_col: str, label: str, numeric: Sequence[str], categorical: Sequence[str], seed: int = 42,
                    folds: int = FOLDS) -> tuple[DataFrame, PipelineModel]:
    """(rows with ``features``, ``label``, ``fold``, ``part``, written once for all fits; the fitted feature stages)."""
    stages = one_hot_stages(categorical) if categorical else []
    inputs = [*numeric, *(c + "_oh" for c in categorical)]
    made = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]).fit(df)
    rows = dealt(made.transform(df), id_col, seed, folds).select("features", F.col(label).cast("double").alias("label"), "fold", "part")
    return staged(rows, "search-features"), made


def forest_search(train: DataFrame, id_col: str, label: str, numeric: Sequence[str], categorical: Sequence[str],
                  candidates: Sequence[Mapping], task: str = "regression", seed: int = 42, **options) -> tuple[PipelineModel, DataFrame]:
    """(the best forest as a pipeline model of features and forest, fitted on all of ``train``; ``search``'s table).

    A candidate names ``num_trees``, ``max_depth`` and ``min_instances``; a rung grows its share of the trees.
    """
    make = forest.regressor if task == "regression" else forest.classifier
    rows, features = staged_features(train, id_col, label, numeric, categorical, seed, options.get("folds", FOLDS))

    def grown(candidate: Mapping, share: float):
        given = {**candidate, "num_trees": max(1, round(candidate["num_trees"] * share))}
        return make("label", seed=seed, **given).setFeaturesCol("features")

    best, table = search(rows, candidates, lambda c, share, fitted, scored: grown(c, share).fit(fitted).transform(scored), task, **options)
    return PipelineModel([*features.stages, grown(candidates[best], 1.0).fit(rows.where("label IS NOT NULL"))]), table
