"""Random-forest models (ML5, ML6, ML15-ML17) as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.ml.metrics import classification_report, regression_metrics
from kpiforge.ml.prepare import one_hot_stages
from kpiforge.ml.split import train_test
from kpiforge.staging import broadcast_if_small, staged

#: Training tables of at most so many rows are fitted row by row; larger ones are merged into about as many blocks.
WHOLE_ROWS = 200_000
BINS = 32    # Spark's ``maxBins``: a forest tells apart no more values of a number than these
PARTS = 32   # tasks of a merged fit, whatever the cluster's size: the bootstrap depends on them


def pipeline(numeric: Sequence[str], categorical: Sequence[str], estimator,
             scale: bool = False) -> Pipeline:
    """One-hot categoricals, assemble (optionally scale), then the estimator."""
    stages = one_hot_stages(categorical) if categorical else []
    codes = [c + "_oh" for c in categorical]
    inputs = list(numeric) + codes
    if scale and numeric:   # the one-hot vectors stay sparse
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="numeric", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True, withStd=True))
        inputs = ["scaled", *codes]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=[*stages, estimator.setFeaturesCol("features")])


def regressor(label: str, num_trees: int = 100, max_depth: int = 10, seed: int = 42,
              min_instances: int = 1) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                 featureSubsetStrategy="all", seed=seed,
                                 minInstancesPerNode=min_instances)


def classifier(label: str, num_trees: int = 100, max_depth: int = 10, seed: int = 42,
               min_instances: int = 1, weight_col: str | None = None) -> RandomForestClassifier:
    rf = RandomForestClassifier(labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                featureSubsetStrategy="sqrt", seed=seed,
                                minInstancesPerNode=min_instances)
    return rf.setWeightCol(weight_col) if weight_col else rf


def bins(train: DataFrame, numeric: Sequence[str]) -> Bucketizer | None:
    """Cuts every number of more than ``BINS`` values into as many bins of equal counts; NaN lies above all, and a fit refuses null. None if no number has so many."""
    distinct = train.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in numeric]).first() if numeric else {}
    many = [c for c in numeric if distinct[c] > BINS]
    if not many:
        return None
    cuts = train.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.002)
    return Bucketizer(inputCols=many, outputCols=[c + "_bin" for c in many], handleInvalid="keep",
                      splitsArray=[[float("-inf"), *sorted(set(q)), float("inf")] for q in cuts])


def merged(rows: DataFrame, id_col: str, label: str, cols: Sequence[str], blocks: int, by_label: bool, seed: int) -> DataFrame:
    """``cols``, ``label`` (its mean), ``_block`` and ``_weight``: the rows that agree in ``cols`` (and the label, if ``by_label``) dealt to
    ``blocks`` by their ids, one row for each block. A block with a null label keeps it, so a fit refuses it as it would the row."""
    block = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(blocks)).alias("_block")
    n = F.count(F.lit(1))
    keys = [*cols, label] if by_label else list(cols)
    mean = [] if by_label else [F.when(F.count(label) == n, F.avg(label)).alias(label)]
    return rows.groupBy(*keys, block).agg(*mean, n.cast("double").alias("_weight"))


def fit(train: DataFrame, id_col: str, label: str, numeric: Sequence[str], categorical: Sequence[str], estimator,
        scale: bool = False, whole_rows: int | None = None) -> PipelineModel:
    """The pipeline of ``estimator``, fitted on all of ``train``.

    Beyond ``whole_rows``, the rows that no split can tell apart are merged: numbers are binned, and
    rows with equal features become blocks that weigh their rows. Gains and leaf means over blocks
    are those over their rows (the variance inside a block is the same on both sides of a split),
    so a tree's work follows from the number of blocks; the bootstrap draws blocks instead of rows.
    Features that hardly repeat are fitted row by row.
    """
    whole_rows = WHOLE_ROWS if whole_rows is None else whole_rows
    used = list(dict.fromkeys([id_col, label, *numeric, *categorical]))
    if train.count() > whole_rows:
        rows = train = staged(train.select(*used), "forest-train")
        if cut := bins(rows, numeric):
            rows = cut.transform(rows)
        names = [c + "_bin" if cut and c in cut.getInputCols() else c for c in numeric]
        cols = [*names, *categorical]
        cells = max(1, _cells(rows, cols))
        if 2 * cells <= train.count():
            some = staged(merged(rows, id_col, label, cols, max(1, whole_rows // cells),
                                 isinstance(estimator, RandomForestClassifier), estimator.getSeed()), "forest-blocks")
            features = Pipeline(stages=pipeline(names, categorical, estimator, scale).getStages()[:-1]).fit(rows)
            dealt = some.repartition(max(PARTS, cells // 50_000), *cols, "_block").sortWithinPartitions(*some.columns)
            model = estimator.setWeightCol("_weight").fit(features.transform(dealt))
            return PipelineModel([*([cut] if cut else []), *features.stages, model])
    return pipeline(numeric, categorical, estimator, scale).fit(train)


def _cells(rows: DataFrame, cols: Sequence[str]) -> int:
    return rows.agg(F.approx_count_distinct(F.xxhash64(*cols), 0.02)).first()[0]


def _ends(stage) -> tuple[list[str], list[str]]:
    """(input, output) columns of a feature stage."""
    has = lambda name: stage.hasParam(name) and stage.isDefined(name)
    ins = stage.getInputCols() if has("inputCols") else [stage.getInputCol()]
    outs = stage.getOutputCols() if has("outputCols") else [stage.getOutputCol()]
    return list(ins), list(outs)


def predicted(model: PipelineModel, df: DataFrame, whole_rows: int | None = None) -> DataFrame:
    """``df`` with each row's ``prediction``, as ``model.transform`` gives it.

    Beyond ``whole_rows``, rows with equal features (binned ones, if the model bins) are scored once
    and meet their prediction in a join; rows whose features hardly repeat are scored one by one.
    """
    whole_rows = WHOLE_ROWS if whole_rows is None else whole_rows
    plain = lambda: model.transform(df).select(*df.columns, "prediction")
    if df.count() <= whole_rows:
        return plain()
    cut = model.stages[0] if isinstance(model.stages[0], Bucketizer) else None
    rows, stages = (cut.transform(df), model.stages[1:]) if cut else (df, model.stages)
    cols, made = [], set()
    for stage in stages[:-1]:
        ins, outs = _ends(stage)
        cols += [c for c in ins if c not in made and c not in cols]
        made.update(outs)
    if 2 * _cells(rows, cols) > df.count():
        return plain()
    distinct = rows.select(*cols).distinct().repartition(PARTS, *cols)
    found = staged(PipelineModel(list(stages)).transform(distinct).select(
        *[F.col(c).alias(f"_f{i}") for i, c in enumerate(cols)], "prediction"), "forest-scores")
    same = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(cols)]
    return rows.join(broadcast_if_small(found), reduce(lambda a, b: a & b, same), "left").select(*df.columns, "prediction")


def fit_evaluate_regression(df: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                            categorical: Sequence[str] = (), scale: bool = False,
                            seed: int = 42, **rf) -> tuple[PipelineModel, DataFrame]:
    """Hash split, fit on train, (mse, r2, n) on test."""
    data = df.withColumn(label, F.col(label).cast("double"))
    train, test = train_test(data, id_col, seed)
    model = fit(train, id_col, label, numeric, categorical, regressor(label, seed=seed, **rf), scale)
    return model, regression_metrics(predicted(model, test), label, "prediction")


def fit_evaluate_classification(df: DataFrame, id_col: str, label: str,
                                numeric: Sequence[str], categorical: Sequence[str] = (),
                                seed: int = 42, **rf) -> tuple[PipelineModel, DataFrame]:
    """Hash split, fit on train, classification report on test."""
    data = df.withColumn(label, F.col(label).cast("double"))
    train, test = train_test(data, id_col, seed)
    model = fit(train, id_col, label, numeric, categorical, classifier(label, seed=seed, **rf))
    return model, classification_report(predicted(model, test), label, "prediction")


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str],
          digits: int | None = 2) -> DataFrame:
    """ML15/ML16: batch scoring of every row, in the label's original units."""
    pred = F.col("prediction")
    return predicted(model, df).select(*keep, (F.round(pred, digits) if digits is not None
                                               else pred).alias("prediction"))
