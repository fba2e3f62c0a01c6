"""K-means over a weighted core set (ML11): all starts run on a bounded sample, all rows are assigned.

The core set is drawn in one pass: a row is taken with a probability that grows with its
squared distance from the mean, and weighs the inverse, so weighted costs estimate costs over
all rows. Which rows are taken follows from hashes of their ids, so a repeated task takes the
same. Tables of at most ``CORE_ROWS`` rows are their own core set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE_ROWS = 20_000
INVALID = -1   # cluster of the rows that lack a feature
SEEDS = tuple(range(42, 52))


def complete(df: DataFrame, cols: Sequence[str]) -> Column:
    """Whether a row has all features (null and NaN count as missing)."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def share(ids: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the ids only."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 30)) / F.lit(float(1 << 30))


def core_set(df: DataFrame, cols: Sequence[str], ids: Sequence[str], size: int = CORE_ROWS, seed: int = 42) -> DataFrame:
    """``cols`` (double) and ``weight`` of about ``size`` rows, or of all if there are fewer."""
    rows = df.where(complete(df, cols)).select(*[F.col(c).cast("double").alias(c) for c in cols], share(ids, seed).alias("_u"))
    stats = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    if stats.n <= size:
        return rows.withColumn("weight", F.lit(1.0)).drop("_u")
    spread = sum(stats[f"v{i}"] for i in range(len(cols)))
    far = reduce(lambda a, b: a + b, [(F.col(c) - stats[f"m{i}"]) ** 2 for i, c in enumerate(cols)])
    p = F.least(F.lit(1.0), F.lit(0.5 * size / stats.n) * (1 + (far / spread if spread else F.lit(1.0))))
    return rows.withColumn("_p", p).where("_u < _p").select(*cols, (1 / F.col("_p")).alias("weight"))


# ---------------------------------------------------------------- one start, in a task

def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre (the first of equals) and its squared distance."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int, steps: int = 100) -> tuple[np.ndarray, float]:
    """Centres and cost from one random start (distance-weighted seeding, then Lloyd's steps)."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < k:
        gap = nearest(x, centres)[1] * w
        if gap.sum() == 0:   # fewer distinct points than centres
            break
        centres = np.r_[centres, x[[rng.choice(len(x), p=gap / gap.sum())]]]
    for _ in range(steps):
        at, _ = nearest(x, centres)
        total = np.bincount(at, weights=w, minlength=len(centres))
        moved = np.stack([np.bincount(at, weights=w * c, minlength=len(centres)) for c in x.T], axis=1)
        new = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-300)[:, None], centres)
        if np.allclose(new, centres, rtol=1e-9, atol=1e-12):
            break
        centres = new
    centres = centres[np.lexsort(centres.T[::-1])]   # numbered by their first coordinate
    return centres, float((nearest(x, centres)[1] * w).sum())


def fit(df: DataFrame, cols: Sequence[str], ids: Sequence[str], ks: Sequence[int], seeds: Sequence[int] = SEEDS,
        size: int = CORE_ROWS) -> dict[int, np.ndarray]:
    """Best centres for each k over all seeds (``n_init``). Every (k, seed) is a task of its own."""
    spark, names = df.sparkSession, list(cols)
    core = core_set(df, cols, ids, size).toPandas()   # at most about ``size`` rows
    if core.empty:
        return {}
    core = core.sort_values([*names, "weight"], ignore_index=True)   # the same order whatever the partitions
    shared = spark.sparkContext.broadcast((core[names].to_numpy(dtype=np.float64), core["weight"].to_numpy(dtype=np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, w = shared.value
        for jobs in batches:
            done = [weighted_kmeans(x, w, int(k), int(s)) for k, s in zip(jobs["k"], jobs["seed"])]
            yield jobs.assign(cost=[c for _, c in done], centres=[p.ravel().tolist() for p, _ in done])

    jobs = [(int(k), int(s)) for k in ks for s in seeds]
    runs = spark.createDataFrame(jobs, "k int, seed int").repartition(len(jobs), "k", "seed").mapInPandas(
        run, "k int, seed int, cost double, centres array<double>")
    best = runs.groupBy("k").agg(F.min(F.struct("cost", "seed", "centres")).alias("best")).collect()   # one row for each k
    shared.unpersist()
    return {r.k: np.array(r.best.centres).reshape(-1, len(names)) for r in best}


def save_centres(centres: dict[int, np.ndarray], path: str) -> None:
    """Centres as a table (k, cluster, centre)."""
    rows = [(int(k), i, [float(v) for v in c]) for k, points in centres.items() for i, c in enumerate(points)]
    SparkSession.active().createDataFrame(rows, "k int, cluster int, centre array<double>").coalesce(1).write.parquet(path)


def load_centres(path: str) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for r in SparkSession.active().read.parquet(path).orderBy("k", "cluster").collect():   # one row for each centre
        out.setdefault(r.k, []).append(r.centre)
    return {k: np.array(points) for k, points in out.items()}


# ---------------------------------------------------------------- all rows

def _gaps(cols: Sequence[str], centres: np.ndarray) -> Column:
    """(squared distance, number) of the nearest centre, as a struct."""
    return F.array_min(F.array(*[
        F.struct(reduce(lambda a, b: a + b, [(F.col(c).cast("double") - float(v)) ** 2 for c, v in zip(cols, centre)]).alias("d"),
                 F.lit(i).alias("i")) for i, centre in enumerate(centres)]))


def assign(df: DataFrame, cols: Sequence[str], centres: np.ndarray, into: str = "cluster") -> DataFrame:
    """``df`` with each row's cluster; ``INVALID`` for rows that lack a feature."""
    return df.withColumn(into, F.when(complete(df, cols), _gaps(cols, centres)["i"]).otherwise(F.lit(INVALID)))


def sizes(df: DataFrame, cols: Sequence[str], centres: np.ndarray) -> DataFrame:
    """One row per cluster, ``INVALID`` included: n, the mean of each column (``centre_<col>``) and the mean squared distance to the centre given."""
    own = df.select(*cols, F.when(complete(df, cols), _gaps(cols, centres)).alias("g"))
    return own.groupBy(F.coalesce("g.i", F.lit(INVALID)).alias("cluster")).agg(
        F.count("*").alias("n"), *[F.when(F.first("g.i").isNotNull(), F.avg(c)).alias(f"centre_{c}") for c in cols], F.avg("g.d").alias("mean_square"))


def spread_start(df: DataFrame, cols: Sequence[str], k: int) -> np.ndarray:
    """k points along the diagonal through the mean, one standard deviation apart: a start without random numbers."""
    s = df.where(complete(df, cols)).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                                         *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return np.array([[s[f"m{i}"] + (j - (k - 1) / 2) * s[f"s{i}"] for i in range(len(cols))] for j in range(k)])


def lloyd_step(df: DataFrame, cols: Sequence[str], centres: np.ndarray) -> np.ndarray:
    """Centres moved to the means of their rows, over all rows (one row per cluster comes back)."""
    moved = centres.copy()
    for r in sizes(df, cols, centres).where(F.col("cluster") != INVALID).collect():
        moved[r["cluster"]] = [r[f"centre_{c}"] for c in cols]
    return moved
