"""Generic aggregations (AG1-AG11).

Multi-section variants (``*_multi``) compute several "group by X" results
of one frame in a single scan and a single shuffle: each input row is
expanded into one (section, key) row per section by ``inline`` inside the
scan's code-generated stage, and map-side partial aggregation collapses the
expansion before anything is shuffled. A hot key therefore costs one
partial-aggregate row per task, not a third of the table in one reducer.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_counts(df: DataFrame, col: ColumnOrName, key: str = "key", alias: str = "n") -> DataFrame:
    """``Series.value_counts()`` (AG4): null keys dropped (Q12); unordered table."""
    return (df.where(_c(col).isNotNull())
              .groupBy(_c(col).alias(key))
              .agg(F.count(F.lit(1)).alias(alias)))


def explode_sections(df: DataFrame, sections: Mapping[str, ColumnOrName],
                     keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per (input row, section) with columns ``section``, ``key`` + ``keep``.

    Keys are cast to string so different key columns share one column; rows
    whose key is null are dropped, like pandas ``groupby``/``value_counts``.
    """
    structs = [F.struct(F.lit(name).alias("section"), _c(c).cast("string").alias("key"))
               for name, c in sections.items()]
    return (df.select(F.inline(F.array(*structs)), *keep)
              .where(F.col("key").isNotNull()))


def value_counts_multi(df: DataFrame, sections: Mapping[str, ColumnOrName],
                       alias: str = "n") -> DataFrame:
    """Several value_counts in one pass -> (section, key, n)."""
    return (explode_sections(df, sections)
            .groupBy("section", "key")
            .agg(F.count(F.lit(1)).alias(alias)))


def group_agg_multi(df: DataFrame, sections: Mapping[str, ColumnOrName],
                    aggs: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """Same aggregates grouped by several keys in one pass -> (section, key, *aggs).

    ``keep`` names the value columns the aggregate expressions read.
    """
    return (explode_sections(df, sections, keep)
            .groupBy("section", "key")
            .agg(*[expr.alias(name) for name, expr in aggs.items()]))


def group_mean(df: DataFrame, key: ColumnOrName, value: ColumnOrName, alias: str = "mean") -> DataFrame:
    """``groupby(k)[v].mean()`` (AG5); null keys dropped."""
    return df.where(_c(key).isNotNull()).groupBy(_c(key)).agg(F.avg(_c(value)).alias(alias))


def group_sum(df: DataFrame, key: ColumnOrName, value: ColumnOrName, alias: str = "total") -> DataFrame:
    """``groupby(k)[v].sum()`` (AG6); null keys dropped."""
    return df.where(_c(key).isNotNull()).groupBy(_c(key)).agg(F.sum(_c(value)).alias(alias))


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Top key by value, first key (ascending) among ties (AG11, Q15).

    ``orderBy(...).limit(1)`` plans as TakeOrderedAndProject: each task keeps
    its local best row, so only one row per task reaches the final merge.
    """
    return df.orderBy(F.desc(value), F.asc(key)).limit(1)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``unique()`` (AG9)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def mean_above_median(df: DataFrame, value: str) -> DataFrame:
    """Exactly decide ``mean(x) > median(x)`` without materialising a median.

    Spark's exact ``median`` gathers every distinct value of a group into
    one aggregation buffer, which does not scale for a global median. The
    comparison needs less: with ``m`` the mean, ``c`` the number of values
    below ``m``, ``a`` the largest value below ``m`` and ``b`` the smallest
    value at or above ``m`` (all one distributed aggregation), the median is
    below ``m`` iff ``c > n/2``, or ``n`` is even, ``c == n/2`` and
    ``(a+b)/2 < m``. Returns one row (mean, above_median).
    """
    v = F.col(value)
    m = df.agg(F.avg(v)).scalar()
    stats = (df.where(v.isNotNull())
               .agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(v < m).alias("c"),
                    F.max(F.when(v < m, v)).alias("a"),
                    F.min(F.when(v >= m, v)).alias("b"),
                    F.avg(v).alias("mean")))
    n, c, a, b = F.col("n"), F.col("c"), F.col("a"), F.col("b")
    above = (c * 2 > n) | ((n % 2 == 0) & (c * 2 == n) & ((a + b) / 2 < F.col("mean")))
    return stats.select("mean", above.alias("above_median"))
