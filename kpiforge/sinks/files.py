"""Prediction, export and audit writers (SNK2, SNK4, SNK5, SNK6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, cols: Sequence[str] = ("actual", "prediction")) -> None:
    """SNK2: prediction columns as headered CSV (one part file per task)."""
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def export_users(users: DataFrame, path: str) -> None:
    """SNK4: id, email, department, role as CSV."""
    users.select("id", "email", "department", "role").write.mode("overwrite") \
        .option("header", True).csv(path)


AUDIT_SCHEMA = "user_id int, action string, details string"


def append_audit(spark: SparkSession, path: str, user_id: int | None, action: str,
                 details: str | None = None) -> None:
    """SNK5: append one audit row; the timestamp is set by Spark at write time."""
    row = spark.createDataFrame([(user_id, action, details)], AUDIT_SCHEMA)
    row.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def log_predictions(preds: DataFrame, path: str, prediction_type: str,
                    input_cols: Sequence[str], result_cols: Sequence[str],
                    user_id: int | None = None) -> None:
    """SNK6: prediction log rows (type, input JSON, result JSON, timestamp, user)."""
    (preds.select(F.lit(prediction_type).alias("prediction_type"),
                  F.to_json(F.struct(*input_cols)).alias("input_data"),
                  F.to_json(F.struct(*result_cols)).alias("prediction_result"),
                  F.current_timestamp().alias("timestamp"),
                  F.lit(user_id).cast("int").alias("user_id"))
          .write.mode("append").parquet(path))
