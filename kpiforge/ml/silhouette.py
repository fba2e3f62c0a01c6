"""Silhouette scores in true Euclidean distance (ML12).

A row's score compares its mean distance to its own group's rows with that to the nearest
other group's. All pairs of rows are compared, whatever their number: rows are packed into
blocks, a task takes two blocks and adds up the distances in both directions, for all
labellings at once. The work grows with the square of the rows; memory follows from a block.
A caller that names ``exact_rows`` gets an estimate beyond it: every row is scored against a
sample of each group (all rows of small groups) that hashes of the ids choose, and
``error_bound`` says how far the mean score may be off: two standard errors of each row's mean
distances, averaged. No registered query asks for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.ml.coreset import complete, share
from kpiforge.staging import staged

MAX_GROUPS = 400
MAX_CELLS = 4_096       # combinations of labels that rows are ordered by
LEAST_SAMPLE = 50
BLOCK = 32              # rows whose distances to the sample are held at once: they stay in a core's cache
TASK_ROWS = 25_000      # rows of a task at most, beyond what the cores need
PACK_ROWS = 65_536      # rows of a block about; a task compares two blocks
LEAST_ROWS = 2_048      # blocks aren't made smaller than this to occupy more cores
MAX_SUMS = 8_000_000    # sums (rows x groups) of a block about
SIDE = 256              # rows and columns of the distances held at once
PART_ROWS = 4_096       # rows whose sums are put together in one group
CLOSE = 1e-6


def sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a row contributes to the product as left and as right factor, and its squared length."""
    own, one = (x * x).sum(axis=1), np.ones(len(x))
    return np.c_[-2 * x, own, one], np.c_[x, one, own].T, own


def mended(d: np.ndarray, x: np.ndarray, ref: np.ndarray, own: np.ndarray, most: float) -> np.ndarray:
    """Squares that the product may have cancelled, by differences (equal rows give 0)."""
    if not d.min(initial=np.inf) > CLOSE * (own.max(initial=0.0) + most):
        i, j = np.nonzero(~(d > CLOSE * (own + most)[:, None]))
        d[i, j] = ((x[i] - ref[j]) ** 2).sum(axis=1)
    return d


def squares(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs: |a|^2 + |b|^2 - 2ab as one product, by differences where that would cancel (equal rows give 0)."""
    (left, _, own), (_, right, other) = sides(x), sides(ref)
    return mended(left @ right, x, ref, own, other.max(initial=0.0))


# ---------------------------------------------------------------- all pairs

def members(codes: np.ndarray, groups: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ``SIDE`` rows: which combination of groups each row has, and the groups of each combination."""
    out = []
    for a in range(0, len(codes), SIDE):
        kinds, at = np.unique(codes[a:a + SIDE], axis=0, return_inverse=True)
        which, held = np.eye(len(kinds))[at.ravel()], np.zeros((len(kinds), groups))
        k, c = np.nonzero(kinds >= 0)
        held[k, kinds[k, c]] = 1
        out.append((which, held) if len(kinds) <= groups else (which @ held, np.eye(groups)))
    return out


def pair_sums(x: np.ndarray, xcodes: np.ndarray, y: np.ndarray, ycodes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's summed distances to every group's rows on the other side: (of x, of y).

    ``codes``: each row's group in every labelling, all numbered together; negative: none. With
    ``y is x``, both results are the sums among the rows of ``x``.
    """
    alone = y is x
    (left, _, own), (_, right, far) = sides(x), sides(y)
    xs, ys, buffer = members(xcodes, groups), members(ycodes, groups), np.empty((SIDE, SIDE))
    out = np.zeros((len(x), groups))
    back = out if alone else np.zeros((len(y), groups))
    for j, (in_y, of_y) in enumerate(ys):
        b = slice(j * SIDE, (j + 1) * SIDE)
        ref, columns, most = y[b], np.ascontiguousarray(right[:, b]), far[b].max()
        for i, (in_x, of_x) in enumerate(xs[:j + 1] if alone else xs):
            a = slice(i * SIDE, (i + 1) * SIDE)
            part = x[a]
            d = np.matmul(left[a], columns, out=buffer if len(part) == len(ref) == SIDE else None)
            d = mended(d, part, ref, own[a], most)
            np.sqrt(d, out=d)
            out[a] += d @ in_y @ of_y
            if not (alone and i == j):
                back[b] += (in_x.T @ d).T @ of_x
    return out, back


def separation(mean: np.ndarray, own: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's score, whether it has one (else 0), the larger of both means and the nearest other group. ``mean`` loses the own group's."""
    i = np.arange(len(mean))
    near = mean[i, own].copy()
    mean[i, own] = np.inf
    other = mean.argmin(axis=1)
    far, most = mean[i, other], np.maximum(near, mean[i, other])
    ok = (whole[own] > 1) & (most > 0)
    return np.where(ok, (far - near) / np.where(ok, most, 1), 0.0), ok, most, other


def of_all_pairs(rows: DataFrame, names: list[str], found: dict[str, dict[str, int]]) -> dict[str, tuple[int, float]]:
    """n and mean score of each labelling. ``rows``: ``names``, ``l_<labelling>`` and ``p``, a number in [0, 1) of the row; ``found``: rows of each label."""
    labels, d = list(found), len(names)
    whole = [np.array(list(found[c].values()), dtype=np.int64) for c in labels]
    first = np.cumsum([0, *map(len, whole)])
    groups = int(first[-1])

    def number(c: str, start: int):
        places = F.create_map(*[F.lit(v) for i, label in enumerate(found[c]) for v in (label, int(start) + i)])
        return F.coalesce(F.element_at(places, F.col(f"l_{c}")), F.lit(-1))

    codes = [f"g{i}" for i in range(len(labels))]
    rows = rows.select(*names, "p", *[number(c, s).alias(g) for c, s, g in zip(labels, first, codes)]).where(F.greatest(*codes, F.lit(-1)) >= 0)
    # Blocks hold neighbours in the order of the cells, so that a block meets few groups. Hashes divide a cell, so that no key can fill a block.
    keys = list(codes)
    while len(cells := rows.groupBy(*keys).agg(F.count("*").alias("cell")).limit(MAX_CELLS + 1).collect()) > MAX_CELLS:
        keys.pop()
    cells.sort()
    sizes = np.cumsum([0, *(r.cell for r in cells)])
    n, cores = int(sizes[-1]), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(n / PACK_ROWS), math.ceil(n * groups / MAX_SUMS), min(math.ceil(math.sqrt(8 * cores)), n // LEAST_ROWS), 1)
    start = rows.sparkSession.createDataFrame([(*r, int(s)) for r, s in zip(cells, sizes)], ", ".join([*[f"{k} int" for k in keys], "cell long", "start long"]))
    block = F.floor((F.col("start") + F.floor(F.col("p") * F.col("cell"))) * blocks / n).cast("int")
    rows = rows.join(F.broadcast(start), keys).select(block.alias("block"), *codes, *names)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*codes, *names])
        return pd.DataFrame({"block": [key[0]], "x": [pdf[names].to_numpy(dtype=np.float64).tobytes()], "codes": [pdf[codes].to_numpy(dtype=np.int32).tobytes()]})

    def sums_of(block: int, other: int, sums: np.ndarray, codes: np.ndarray, met: np.ndarray) -> Iterator[pd.DataFrame]:
        """Sums over the groups that ``met`` holds, in parts; a block's own tile also carries the codes."""
        held = np.unique(met[met >= 0])
        for a in range(0, len(sums), PART_ROWS):
            b = slice(a, a + PART_ROWS)
            yield pd.DataFrame({"block": [block], "part": [a // PART_ROWS], "other": [other], "held": [held.astype(np.int32).tobytes()],
                                "sums": [sums[b][:, held].tobytes()], "codes": [codes[b].tobytes() if block == other else None]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, tuple] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                here = (r.block, np.frombuffer(r.x).reshape(-1, d), np.frombuffer(r.codes, dtype=np.int32).reshape(-1, len(labels)))
                if r.block != r.other and r.tile not in waiting:
                    waiting[r.tile] = here
                    continue
                (i, x, xc), (j, y, yc) = here, here if r.block == r.other else waiting.pop(r.tile)
                own, back = pair_sums(x, xc, y, yc, groups)
                yield from sums_of(i, j, own, xc, yc)
                if i != j:
                    yield from sums_of(j, i, back, yc, xc)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("other")
        at = np.frombuffer(pdf.loc[pdf["codes"].notna(), "codes"].iloc[0], dtype=np.int32).reshape(-1, len(labels))
        total, out = np.zeros((len(at), groups)), []
        for held, sums in zip(pdf["held"], pdf["sums"]):
            total[:, np.frombuffer(held, dtype=np.int32)] += np.frombuffer(sums).reshape(len(at), -1)
        for k, size in enumerate(whole):
            has = at[:, k] >= 0
            g = at[has, k] - first[k]
            seen = np.tile(size.astype(np.float64), (len(g), 1))
            seen[np.arange(len(g)), g] -= 1
            s = separation(total[has, first[k]:first[k + 1]] / np.maximum(seen, 1), g, size)[0]
            out.append((k, len(s), s.sum()))
        return pd.DataFrame(out, columns=["labelling", "n", "s"])

    # Every two blocks meet in a tile of their own, a task each; the half tiles of one block come last.
    low, high = F.least("block", "other"), F.greatest("block", "other")
    half = blocks * (blocks - 1) // 2
    tile = F.when(low == high, low + half).otherwise((low * (2 * blocks - low - 1) / 2).cast("int") + high - low - 1)
    packed = rows.groupBy("block").applyInPandas(pack, "block int, x binary, codes binary")
    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("tile", tile)
    sums = tiles.repartitionById(half + blocks, "tile").mapInPandas(compare, "block int, part int, other int, held binary, sums binary, codes binary")
    done = sums.groupBy("block", "part").applyInPandas(finish, "labelling int, n long, s double")
    out = done.groupBy("labelling").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()   # one row for each labelling
    return {labels[r.labelling]: (r.n, r.s / r.n) for r in out}


# ---------------------------------------------------------------- an estimate, for callers that ask for it

def scores(x: np.ndarray, own: np.ndarray, taken: np.ndarray, ref: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and error of each row of ``x``.

    ``own``: the row's group; ``taken``: whether it is in the sample; ``ref``: the sample, group
    by group; ``counts``: sampled rows, ``whole``: all rows of each group.
    """
    starts, out, err = np.cumsum(counts) - counts, np.zeros(len(x)), np.zeros(len(x))
    for a in range(0, len(x), BLOCK):
        part, g, t = x[a:a + BLOCK], own[a:a + BLOCK], taken[a:a + BLOCK]
        d2 = squares(part, ref)
        total, square = np.add.reduceat(np.sqrt(d2), starts, axis=1), np.add.reduceat(d2, starts, axis=1)
        i = np.arange(len(part))
        seen = np.tile(counts.astype(np.float64), (len(part), 1))
        seen[i, g] -= t
        mean = total / np.maximum(seen, 1)
        error = np.sqrt(np.maximum(square / np.maximum(seen, 1) - mean ** 2, 0) / np.maximum(seen, 1)) * (counts < whole)
        out[a:a + BLOCK], ok, most, other = separation(mean, g, whole)
        err[a:a + BLOCK] = np.where(ok, 2 * (error[i, g] + error[i, other]) / np.where(ok, most, 1), 0.0)
    return out, err


def of_samples(own: DataFrame, names: list[str], found: dict[str, int], exact_rows: int) -> tuple[int, float, float]:
    """n, mean score and error bound of one labelling. ``own``: ``names``, ``label`` and ``u``, a number in [0, 1) of the ids."""
    spark, n = own.sparkSession, sum(found.values())
    each = exact_rows // len(found)
    chance = F.element_at(F.create_map(*[F.lit(v) for label, size in found.items() for v in (label, min(1.0, each / size))]), F.col("label"))
    number = F.element_at(F.create_map(*[F.lit(v) for i, label in enumerate(found) for v in (label, i)]), F.col("label"))
    own = own.select(*names, number.alias("g"), (F.col("u") < chance).alias("t"))
    sample = own.where("t").drop("t").toPandas().sort_values(["g", *names], ignore_index=True)   # about ``exact_rows`` rows
    whole = np.array(list(found.values()), dtype=np.int64)
    counts = np.bincount(sample["g"], minlength=len(found))
    shared = spark.sparkContext.broadcast(sample[names].to_numpy(dtype=np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, e = scores(pdf[names].to_numpy(dtype=np.float64), pdf["g"].to_numpy(), pdf["t"].to_numpy(), shared.value, counts, whole)
            yield pd.DataFrame({"s": s, "e": e})

    spread = own.repartition(max(spark.sparkContext.defaultParallelism, n // TASK_ROWS))   # few rows, many distances
    r = spread.mapInPandas(run, "s double, e double").agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.avg("e").alias("e")).first()
    return r.n, r.s, r.e


# ---------------------------------------------------------------- labellings

def silhouettes(df: DataFrame, cols: Sequence[str], labels: Sequence[str], ids: Sequence[str],
                exact_rows: int | None = None, seed: int = 42) -> DataFrame:
    """One row per label column: labelling, groups, n, silhouette, error_bound (0: exact).

    Rows that lack a column or the label are left out. Groups of one row score 0. Fewer than two
    groups have no silhouette (null). At most ``MAX_GROUPS`` groups. Exact, unless a caller names
    ``exact_rows``: labellings of more rows are then estimated, of at most ``exact_rows / LEAST_SAMPLE`` groups.
    """
    names, limit = [f"x{i}" for i in range(len(cols))], MAX_GROUPS if exact_rows is None else exact_rows // LEAST_SAMPLE
    rows = df.where(complete(df, cols)).select(*[F.col(c).cast("double").alias(x) for x, c in zip(names, cols)], *[F.col(c).cast("string").alias(f"l_{c}") for c in labels],
                                               share(ids, seed).alias("u"), share([*ids, *cols], seed).alias("p"))
    rows = staged(rows, "silhouette-rows")
    found: dict[str, dict[str, int]] = {}
    for label in labels:
        counts = rows.where(F.col(f"l_{label}").isNotNull()).groupBy(f"l_{label}").agg(F.count("*").alias("n")).orderBy(f"l_{label}").limit(limit + 1).collect()
        if len(counts) > limit:
            raise ValueError(f"more than {limit} groups in {label}")
        found[label] = {r[0]: r.n for r in counts}
    size = {c: sum(of.values()) for c, of in found.items()}
    out = {c: (size[c], None, 0.0) for c in labels if len(found[c]) < 2}
    if whole := [c for c in labels if c not in out and (exact_rows is None or size[c] <= exact_rows)]:
        out |= {c: (*r, 0.0) for c, r in of_all_pairs(rows, names, {c: found[c] for c in whole}).items()}
    for c in labels:
        if c not in out:
            own = rows.where(F.col(f"l_{c}").isNotNull()).select(*names, F.col(f"l_{c}").alias("label"), "u")
            out[c] = of_samples(own, names, found[c], exact_rows)
    return df.sparkSession.createDataFrame([(c, len(found[c]), *out[c]) for c in labels],
                                           "labelling string, groups int, n long, silhouette double, error_bound double")
