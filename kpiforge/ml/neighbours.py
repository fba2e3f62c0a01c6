"""Nearest rows of every row of one table, by buckets along a space-filling curve.

Each row gets the place of its cell on a Z-order curve, which runs through near cells one after the
other. Rows are ranked along the curve and cut into half-buckets of ``HALF`` rows; a task compares
the rows of one half-bucket with those of it and of the two beside it. Rows that the curve parts meet
on other curves, each over a grid shifted by another vector. Work and memory follow the number of
rows: there is no bound on rows, and none is left out as a base. Tables of at most ``2 * HALF`` rows
are compared in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.operators.rank import global_rank
from kpiforge.staging import staged

HALF = 512
CURVES = 8


def z_order(cells: Sequence[Column], bits: int) -> Column:
    """The cells' bits, interleaved."""
    d = len(cells)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(c, j).bitwiseAND(F.lit(1).cast("long")), j * d + i)
                                                for j in range(bits) for i, c in enumerate(cells)])


def nearest_rows(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, half: int = HALF, curves: int = CURVES,
                 seed: int = 42) -> DataFrame:
    """(id, v, near): each row's vector and its ``k`` nearest other rows as (d, id, v), nearest first, ties by id.

    Euclidean distance over ``cols`` as they are. Rows lacking a value are left out; ids are text
    and should differ (rows of one id are never neighbours of each other).
    """
    v = F.array(*[F.col(c).cast("double") for c in cols])
    rows = staged(df.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))), "neighbour-rows")
    d = len(cols)
    s = rows.agg(F.count("*").alias("n"), *[F.min(F.col("v")[i]).alias(f"a{i}") for i in range(d)], *[F.max(F.col("v")[i]).alias(f"b{i}") for i in range(d)]).first()
    if not s.n:
        return rows.withColumn("near", F.lit(None).cast("array<struct<d:double,id:string,v:array<double>>>"))
    width = max(s[f"b{i}"] - s[f"a{i}"] for i in range(d)) or 1.0
    bits = min(20, 62 // d)
    shifts = np.random.default_rng(seed).random((curves, d))
    shifts[0] = 0
    found = None
    for shift in shifts[:1] if s.n <= 2 * half else shifts:
        cells = [F.floor(((F.col("v")[i] - s[f"a{i}"]) / width + float(shift[i])) * float(1 << (bits - 1))).cast("long") for i in range(d)]
        part = _compared(global_rank(rows.withColumn("z", z_order(cells, bits)), ["z", "id"], name="neighbour-curve"), k, half if s.n > 2 * half else s.n)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", F.col("near_id").alias("id"), F.col("near_v").alias("v")))), 1, k).alias("near"))
    return rows.join(best, "id", "left")


def _compared(ranked: DataFrame, k: int, half: int) -> DataFrame:
    """(id, near_id, near_v, d): the nearest that each row meets in its half-bucket and the two beside it."""
    h = F.floor(F.col("place") / half)
    met = ranked.select("id", "v", h.alias("h"), F.explode(F.array(h - 1, h, h + 1)).alias("task"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        own = np.flatnonzero(pdf["h"] == pdf["task"])
        out = []
        for a in range(0, len(own), 128):
            i = own[a:a + 128]
            gap = ((x[i, None] - x[None]) ** 2).sum(axis=2)
            gap[ids[i, None] == ids[None]] = np.inf
            near = np.argsort(gap, axis=1, kind="stable")[:, :k]   # rows are in id order, so ties go to the smaller id
            r, c = np.repeat(np.arange(len(i)), near.shape[1]), near.ravel()
            ok = np.isfinite(gap[r, c])
            out.append(pd.DataFrame({"id": ids[i[r[ok]]], "near_id": ids[c[ok]], "near_v": list(x[c[ok]]), "d": np.sqrt(gap[r[ok], c[ok]])}))
        none = pd.DataFrame({"id": [], "near_id": [], "near_v": [], "d": []}).astype({"id": object, "near_id": object, "near_v": object})
        return pd.concat(out) if sum(map(len, out)) else none   # beyond the ends of the curve there are only visitors

    return met.groupBy("task").applyInPandas(compare, "id string, near_id string, near_v array<double>, d double")
