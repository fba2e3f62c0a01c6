"""Synthetic minority oversampling (ML7) over the whole minority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.ml.neighbours import nearest_rows
from kpiforge.operators.rank import global_rank
from kpiforge.operators.topk import append_rows

NEIGHBOURS = 5


def oversample(train: DataFrame, id_col: str, label: str, numeric: Sequence[str], k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """``train`` (id, label 0/1, numeric columns) with synthetic rows until both labels are equal.

    Each synthetic row lies between a minority row and one of its ``k`` nearest minority rows
    (``neighbours.nearest_rows``). Every minority row with all values is a base, and they take
    turns: bases are numbered by id, synthetic row ``n`` belongs to base ``n`` modulo their number.
    Which neighbour, and where between, follows from hashes of ``n``, so any partitioning gives the
    same rows. Synthetic ids are ``synthetic-<n>``; ids are text in the result.
    """
    cols = [F.col(c).cast("double").alias(c) for c in numeric]
    rows = train.select(F.col(id_col).cast("string").alias(id_col), F.col(label).cast("int").alias(label), *cols)
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}   # two labels
    if len(counts) < 2 or counts[0] == counts[1]:
        return rows
    minority = min(counts, key=counts.get)
    missing = counts[1 - minority] - counts[minority]
    bases = global_rank(nearest_rows(rows.where(F.col(label) == minority), id_col, numeric, k, seed=seed), ["id"], name="oversample-bases")
    m = bases.count()
    if not m:
        return rows
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(missing - 1) - F.col("place")) / m))
    made = bases.where(F.col("place") < missing).select("v", "near", "place", F.explode(turns).alias("turn"))
    made = made.withColumn("n", F.col("turn") * m + F.col("place"))
    pick = F.pmod(F.xxhash64("n", F.lit(seed)), F.size("near")).cast("int")
    weight = F.pmod(F.xxhash64("n", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    other = F.when(F.size("near") > 0, F.col("near")[pick]["v"]).otherwise(F.col("v"))   # a lone row is repeated
    made = made.select("n", "v", other.alias("o"), weight.alias("w"))
    made = made.select(F.concat(F.lit("synthetic-"), F.col("n").cast("string")).alias(id_col), F.lit(minority).alias(label),
                       *[(F.col("v")[i] + F.col("w") * (F.col("o")[i] - F.col("v")[i])).alias(c) for i, c in enumerate(numeric)])
    return append_rows(rows, made)
