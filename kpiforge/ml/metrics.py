"""Model metrics as plain aggregations (ML9, ML10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """ML10: one row (mse, r2, n) in one pass.

    r2 = 1 - SSE/SST with SST = n * var_pop(label); Spark's variance is an
    online (numerically stable) aggregate, so no second pass for the mean.
    """
    err = F.col(label) - F.col(prediction)
    n = F.count(F.lit(1))
    return df.agg(F.avg(err * err).alias("mse"),
                  (F.lit(1.0) - F.sum(err * err) / (F.var_pop(label) * n)).alias("r2"),
                  n.alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n)."""
    return (df.groupBy(F.col(label).cast("int").alias("actual"),
                       F.col(prediction).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))


def classification_report(df: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """ML9: per-class precision/recall/f1/support, accuracy, macro and weighted avg.

    Works from the confusion table, whose size is bounded by the number of
    classes squared. Rows: ``cls`` = class label text, 'accuracy',
    'macro avg', 'weighted avg' (sklearn's layout; accuracy repeats in the
    three score columns, support = total).
    """
    cm = confusion(df, label, prediction)
    support = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred"))
    tp = cm.where(F.col("actual") == F.col("predicted")).select(
        F.col("actual").alias("cls"), F.col("n").alias("tp"))
    per = (support.join(predicted, "cls", "full_outer").join(tp, "cls", "left")
           .na.fill(0, ["support", "pred", "tp"]))
    p = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("cls", p.alias("precision"), r.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    total = F.sum("support")
    acc = F.sum("tp") / total
    summary = per.agg(
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), total.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                 total.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("cls"),
                 (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
                 total.alias("support")).alias("w"))
    tail = summary.select(F.inline(F.array("a", "m", "w")))
    head = per.select(F.col("cls").cast("string").alias("cls"), "precision", "recall", "f1",
                      "support")
    return head.unionByName(tail)
