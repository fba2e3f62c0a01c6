"""Mergeable states of grouped measures: counts, sums, squares, least and most.

One pass over a table gives the states of all sections ("group by X" for several X) at once;
states of parts (days, files) merge by adding up, and means, variances and shares follow from
the merged ones. ``squares`` are sums of ``x * x``: fine for measures whose mean isn't many
orders of magnitude above their spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("n", "sum", "squares", "least", "most")


def partial_states(df: DataFrame, sections: Mapping[str, Column], measures: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., section, key, n, <measure>_<stat>...): one expand and one aggregation for all sections.

    Rows with a null key are left out of that section (Q12); null measures are left out of that measure.
    """
    expand = F.inline(F.array(*[F.struct(F.lit(s).alias("section"), c.cast("string").alias("key")) for s, c in sections.items()]))
    values = df.select(*by, *[c.cast("double").alias(f"x_{m}") for m, c in measures.items()], expand).where(F.col("key").isNotNull())
    aggs = [F.count("*").alias("n")]
    for m in measures:
        x = F.col(f"x_{m}")
        aggs += [F.count(x).alias(f"{m}_n"), F.sum(x).alias(f"{m}_sum"), F.sum(x * x).alias(f"{m}_squares"),
                 F.min(x).alias(f"{m}_least"), F.max(x).alias(f"{m}_most")]
    return values.groupBy(*by, "section", "key").agg(*aggs)


def merged_states(states: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """States of parts added up."""
    how = {"n": F.sum, "sum": F.sum, "squares": F.sum, "least": F.min, "most": F.max}
    return states.groupBy(*by, "section", "key").agg(
        F.sum("n").alias("n"), *[how[s](f"{m}_{s}").alias(f"{m}_{s}") for m in measures for s in STATS])


def mean(m: str) -> Column:
    return F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n"))


def deviation(m: str) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.greatest(F.try_divide(F.col(f"{m}_squares"), F.col(f"{m}_n")) - mean(m) * mean(m), F.lit(0.0)))
