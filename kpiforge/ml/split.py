"""Deterministic train/test split (ML4).

``randomSplit`` depends on partitioning and sort order, so a re-run after
an executor loss or a repartition can move rows between sides. The split
here is a pure function of the row id: the first 32 bits of
``md5(id || '|' || seed)`` modulo 100, below ``train_pct`` -> train.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_part(id_col: Column | str, seed: int, parts: int) -> Column:
    """A number from 0 to ``parts`` - 1 that depends on the id and the seed only."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(parts))


def split_bucket(id_col: Column | str, seed: int = 42) -> Column:
    return hash_part(id_col, seed, 100)


def is_train(id_col: Column | str, seed: int = 42, train_pct: int = 80) -> Column:
    return split_bucket(id_col, seed) < train_pct


def train_test(df: DataFrame, id_col: str, seed: int = 42,
               train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    flag = is_train(id_col, seed, train_pct)
    return df.where(flag), df.where(~flag)
