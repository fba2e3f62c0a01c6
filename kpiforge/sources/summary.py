"""Stored summaries: read, read-or-compute, defaults (SRC2-SRC4)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.sinks.summary import write_summary


STORED = "section string, name string, key string, value string, department string"
#: What Spark says of a damaged Parquet file.
UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def read_summary(spark: SparkSession, root: str, department: str) -> DataFrame:
    """SRC2: one department of the stored summary (partition-pruned read)."""
    return spark.read.schema(STORED).parquet(root).where(F.col("department") == department)


def get_or_build_summary(spark: SparkSession, root: str, department: str,
                         build: Callable[[], DataFrame]) -> DataFrame:
    """SRC3: reuse the stored summary, or build, write and re-read it.

    Missing, empty or unreadable partitions count as absent (the reference
    rebuilds on a missing or corrupt JSON file). The schema is given, so a
    corrupt file of another department doesn't fail this one's read; all rows
    of the partition are read to find out whether they are readable.
    """
    try:
        stored = read_summary(spark, root, department)
        if stored.agg(F.count("section"), F.sum(F.length("value"))).first()[0]:
            return stored
    except AnalysisException:   # no such table
        pass
    except (PySparkException, Py4JJavaError) as e:   # a file that isn't readable Parquet
        if not any(x in str(e) for x in UNREADABLE):
            raise
    write_summary(build(), root)
    return read_summary(spark, root, department)


def with_default_metrics(metrics: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """SRC4: every default metric present; missing or null -> its default."""
    cols = {k: (F.coalesce(F.col(k), F.lit(v)) if k in metrics.columns else F.lit(v))
            for k, v in defaults.items()}
    return metrics.withColumns(cols)
