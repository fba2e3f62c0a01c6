"""Feature preparation (ML1-ML3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.operators.rank import global_rank
from kpiforge.staging import broadcast_if_small, staged


def sorted_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(label, code) of a column's distinct labels in sorted order, codes from 0.

    The labels are ranged over the tasks and numbered there (``global_rank``), so a column with
    as many labels as rows never meets on the driver.
    """
    labels = df.select(F.col(f"`{col}`").cast("string").alias("label")).where("label IS NOT NULL").distinct()
    return global_rank(labels, ["label"], into="code", name="dictionary")


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """ML1: adds integer ``<col>_code`` columns, codes in sorted label order (``LabelEncoder``).

    A null label gets the code after the last one.
    """
    for c in cols:
        codes = staged(sorted_dictionary(df, c), "codes").withColumnsRenamed({"label": "_label", "code": "_code"})
        met = df.join(broadcast_if_small(codes), F.col(f"`{c}`").cast("string") == F.col("_label"), "left")
        df = met.withColumn(c + suffix, F.coalesce("_code", F.lit(codes.count())).cast("int")).drop("_label", "_code")
    return df


def one_hot_stages(cols: Sequence[str]) -> list:
    """ML2: ``get_dummies`` (every level kept) as pipeline stages."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[c + "_idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in cols], outputCols=[c + "_oh" for c in cols],
                        dropLast=False, handleInvalid="keep")
    return [idx, ohe]


def zscore(df: DataFrame, cols: Sequence[str], prefix: str = "z_", fit_on: DataFrame | None = None) -> DataFrame:
    """ML3: ``(x - mean) / population std`` for each column (Q17).

    ``fit_on``: the rows whose statistics are used (a model's training side, Q18); default all.

    All means and deviations come from one aggregation, used as a single
    scalar subquery (a struct), so the data is scanned once for the stats.
    """
    stats = (df if fit_on is None else fit_on).agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("s")).scalar()
    return df.withColumns({f"{prefix}{c}": (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]
                           for c in cols})
