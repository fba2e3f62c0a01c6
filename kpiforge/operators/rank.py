"""Places of all rows in a global order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.staging import staged


def global_rank(df: DataFrame, order: Sequence[str | Column], into: str = "place", name: str = "ranked") -> DataFrame:
    """``df`` with ``into``: each row's place (0, 1, ...) by ``order``; ties in any order, but fixed.

    Rows are dealt by ranges and sorted within them; the rows of the ranges before are
    added to the place within the own range. Only one count per range is brought together.
    ``df`` must not have columns named ``_seq`` or ``_range``.
    """
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_seq", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_seq", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))  # a row for each range
    return (placed.join(F.broadcast(ranges), "_range")
            .withColumn(into, F.col("_seq") - F.col("_first") + F.col("_before")).drop("_range", "_seq", "_first", "_n", "_before"))
