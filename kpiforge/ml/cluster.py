"""Clustering (ML11-ML14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


INVALID = -1   # cluster of the rows that lack a feature


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Rows with all features, assembled; ``cluster_counts`` reports the others as ``INVALID``."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, k: int, seeds: Sequence[int] = tuple(range(42, 52)),
           features: str = "features") -> KMeansModel:
    """ML11: k-means, best of several seeds by training cost (``n_init``).

    The feature frame is persisted for the runs and released afterwards.
    """
    data = df.select(features).persist()
    try:
        best = None
        for s in seeds:
            m = KMeans(k=k, seed=s, featuresCol=features, predictionCol="cluster").fit(data)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
        return best
    finally:
        data.unpersist()


def silhouette_sweep(df: DataFrame, ks: Sequence[int] = (2, 3, 4, 5),
                     seeds: Sequence[int] = tuple(range(42, 52)), features: str = "features") -> DataFrame:
    """ML12: silhouette per k -> (k, silhouette). Spark's silhouette uses
    squared Euclidean distance, so scores differ from the reference's."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    rows = []
    for k in ks:
        model = kmeans(df, k, seeds, features)
        rows.append((int(k), float(ev.evaluate(model.transform(df)))))
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "k int, silhouette double")


def best_k(sweep: DataFrame) -> int:
    """argmax of the sweep (a handful of rows)."""
    return int(sweep.orderBy(F.desc("silhouette"), F.asc("k")).first()["k"])


def cluster_counts(model: KMeansModel, df: DataFrame, everything: DataFrame | None = None,
                   cols: Sequence[str] = ()) -> DataFrame:
    """(cluster, n); with ``everything``, its rows that lack one of ``cols`` count as ``INVALID``."""
    counts = model.transform(df).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    if everything is None:
        return counts
    lacks = F.greatest(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols]) if len(cols) > 1 \
        else F.col(cols[0]).isNull()
    rest = everything.agg(F.count_if(lacks).alias("n")).where("n > 0")
    return counts.unionByName(rest.select(F.lit(INVALID).alias("cluster"), "n"))


def pca_2d(df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """ML13: first two principal components (plot-ready table)."""
    model = PCA(k=2, inputCol=features, outputCol="pc").fit(df)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df).withColumn("pc", vector_to_array("pc"))
    return out.select(*keep, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
