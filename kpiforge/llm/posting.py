"""Nearest neighbours by inner product over balanced posting lists.

Fit, on a bounded sample: median splits along the line between two means give lists of equal
size; their means are the centroids, joined to their nearest fellows in a graph. Inner product
becomes distance by one more component, ``sqrt(longest^2 - |x|^2)`` for rows and 0 for queries.

Index: every row goes to its nearest list, and to those whose centroid is at most ``REPLICATE``
times as far (``REPLICAS`` at most). Lists are kept in blocks, so a full list is many tasks.

Search: a best-first walk over the centroid graph, held in memory by each task, finds the lists
whose centroid is at most ``ratio`` times as far as the nearest. The ratio is the smallest that
finds ``RECALL`` of the sample's true neighbours in the sample, where they are sparser, so the
full table does no worse. Lists and their queries meet block by block; a task keeps the best per
query over the blocks of a list, so the candidates are at most ``k + 1`` for each query and list.
Scores are inner products of the original vectors in double precision.

Equal vectors are one entry with its smallest ``k + 1`` ids, all that a result can hold.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without id and vectors whose length isn't the table's most common one; ties go to the
smaller id; with fewer rows than ``k``, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import per_batch, staged

LEAST_LISTS, MOST_LISTS = 32, 2_048
SAMPLE_ROWS = 32_768
SAMPLE_BYTES = 64 << 20
REPLICATE, REPLICAS = 1.01, 3
NEIGHBOURS = 12
RECALL = 0.96
RATIOS = (1.02, 1.05, 1.08, 1.1, 1.12, 1.14, 1.16, 1.18, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0, 4.0)
BLOCK_ROWS, BLOCK_QUERIES = 1_024, 256


# ---------------------------------------------------------------- index in memory

@dataclass
class Lists:
    """Centroids (with the added component), their graph, and the search ratio."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    start: int
    longest: float
    ratio: float = 1.2

    def rows(self, x: np.ndarray) -> np.ndarray:
        gap = np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0)
        return np.c_[x, np.sqrt(gap)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (self.centroids ** 2).sum(axis=1)[None] - 2 * x @ self.centroids.T
        return np.sqrt(np.maximum(d, 0))

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each row: the nearest, and those nearly as near."""
        d = self.distances(self.rows(x))
        keep = min(REPLICAS, d.shape[1])
        near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        dn = np.take_along_axis(d, near, axis=1)
        return [n[r <= REPLICATE * r.min()] for n, r in zip(near, dn)]

    def probe(self, q: np.ndarray, ratio: float | None = None) -> list[int]:
        """Lists at most ``ratio`` times as far as the nearest that the walk finds."""
        ratio, q = ratio or self.ratio, np.r_[q, 0.0]
        seen = np.zeros(len(self.centroids), dtype=bool)
        seen[self.start] = True
        d0 = float(np.linalg.norm(self.centroids[self.start] - q))
        best, heap, found, idle = d0, [(d0, self.start)], [], 0
        while heap:
            d, at = heapq.heappop(heap)
            if d > ratio * best:
                idle += 1
                if idle > NEIGHBOURS:  # the walk may still come closer from just outside
                    break
            best = min(best, d)
            found.append((d, at))
            new = self.graph[at][~seen[self.graph[at]]]
            if len(new):
                seen[new] = True
                for x, n in zip(np.linalg.norm(self.centroids[new] - q, axis=1).tolist(), new.tolist()):
                    heapq.heappush(heap, (x, n))
        return [n for d, n in found if d <= ratio * best]


def fit_lists(sample: np.ndarray, n_rows: int, longest: float, k: int = 20) -> Lists:
    """Balanced lists of a sample for a table of ``n_rows``."""
    index = Lists(np.empty((0, 0)), [], 0, longest)
    x = index.rows(sample)
    want = min(max(LEAST_LISTS, int(n_rows ** 0.5 / 6)), MOST_LISTS, max(1, len(x) // 8))
    size = max(1, -(-len(x) // want))
    rng = np.random.default_rng(11)
    todo, leaves = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            leaves.append(part)
            continue
        own = x[part]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            along = own @ (a - b)
            high = along > np.median(along)
            if not high.any():
                break
            a, b = own[high].mean(axis=0), own[~high].mean(axis=0)
        order = np.argsort(own @ (a - b), kind="stable")
        half = len(order) // 2
        todo += [part[order[:half]], part[order[half:]]]
    index.centroids = np.stack([x[p].mean(axis=0) for p in leaves])
    d = index.distances(index.centroids)
    np.fill_diagonal(d, np.inf)
    keep = min(NEIGHBOURS, len(leaves) - 1)
    near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep else np.empty((len(leaves), 0), int)
    both = [set(r.tolist()) for r in near]
    for i, r in enumerate(near):
        for j in r.tolist():
            both[j].add(i)
    for i in range(1, len(leaves)):  # a chain through all keeps the graph in one piece
        both[i].add(i - 1)
        both[i - 1].add(i)
    index.graph = [np.array(sorted(s), dtype=np.int64) for s in both]
    index.start = int(np.argmin(index.distances(index.centroids.mean(axis=0)[None])[0]))
    index.ratio = _fitted_ratio(index, sample, k)
    return index


def _fitted_ratio(index: Lists, sample: np.ndarray, k: int) -> float:
    """The smallest ratio that finds ``RECALL`` of the sample's neighbours of 256 of its rows."""
    ask = sample[:256]
    score = ask @ sample.T
    score[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return RATIOS[0]
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    where = index.places(sample)
    for ratio in RATIOS:
        hit = 0
        for q, t in zip(ask, true):
            lists = set(index.probe(q, ratio))
            hit += sum(not lists.isdisjoint(where[i].tolist()) for i in t)
        if hit >= RECALL * true.size:
            return ratio
    return RATIOS[-1]


# ---------------------------------------------------------------- Spark

def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec, key) of the rows that take part; ``key``: equal for equal vectors."""
    v = F.col(vector_col)
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0))
    d = d.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    length = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    d = d.where(F.size("vec") == F.lit(length["n"] if length else 0))
    return d.withColumn("key", F.unhex(F.md5(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","))))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``."""
    rows = staged(usable(vectors, id_col, vector_col), "ann-rows")
    first = Window.partitionBy("key").orderBy("id")
    some = (rows.select("key", "id").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
            .groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    distinct = staged(rows.select("key", "vec").dropDuplicates(["key"]).join(some, "key"), "ann-distinct")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("key", F.col("id").alias("query_id")).distinct()

    n, dim, longest = distinct.agg(F.count("*"), F.max(F.size("vec")), F.max(F.sqrt(F.aggregate(
        "vec", F.lit(0.0), lambda s, x: s + x * x)))).first()
    take = min(sample_rows, SAMPLE_BYTES // (8 * (dim or 1)))
    sample = distinct.orderBy(F.xxhash64("key")).limit(take).select("vec").toPandas()["vec"]  # bounded by ``sample_rows``
    if not n:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    index = distinct.sparkSession.sparkContext.broadcast(fit_lists(np.stack(sample.to_numpy()), n, longest, k))

    postings = per_batch(distinct.select("key", "vec", "ids"), _assign(index),
                         "list int, key binary, vec array<double>, ids array<long>")
    postings = staged(_blocks(postings, ["key", "vec", "ids"], BLOCK_ROWS, "rows"), "ann-postings")
    queries = distinct.select("key", "vec").join(asked.select("key").distinct(), "key", "left_semi")
    queries = per_batch(queries, _probe(index), "list int, key binary, vec array<double>")
    queries = staged(_blocks(queries, ["key", "vec"], BLOCK_QUERIES, "asks"), "ann-queries")

    best = per_batch(queries.withColumnRenamed("block", "ask").join(postings.drop("block"), "list")
                     .select("list", "ask", "asks", "rows"), _best(k + 1),
                     "key binary, vec_key binary, score double, ids array<long>")
    best = best.dropDuplicates(["key", "vec_key"]).select("key", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(best, "key").where("query_id != vec_id").withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _blocks(rows: DataFrame, columns: list[str], size: int, name: str) -> DataFrame:
    """One row per block of a list: at most about ``size`` rows each, by hash."""
    rows = staged(rows, "ann-dealt")
    counts = rows.groupBy("list").agg(F.count("*").alias("n"))  # at most MOST_LISTS rows
    return (rows.join(F.broadcast(counts), "list")
            .withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / size)))
            .groupBy("list", "block").agg(F.collect_list(F.struct(*columns)).alias(name)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _dealt(batch: pa.RecordBatch, lists: list) -> pa.RecordBatch:
    take = np.repeat(np.arange(batch.num_rows), [len(p) for p in lists])
    own = pa.array(np.concatenate([np.asarray(p) for p in lists]) if len(take) else [], pa.int32())
    cols = [c.take(pa.array(take, pa.int64())) for c in batch.columns]
    return pa.RecordBatch.from_arrays([own, *cols], ["list", *batch.schema.names])


def _assign(index):
    def run(batches):
        for batch in batches:
            yield _dealt(batch, index.value.places(_matrix(batch.column(1))) if batch.num_rows else [])
    return run


def _probe(index):
    def run(batches):
        for batch in batches:
            yield _dealt(batch, [index.value.probe(q) for q in _matrix(batch.column(1))])
    return run


def _top(owner: np.ndarray, score: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's best ``k``, ties to the smaller ``low``."""
    order = np.lexsort((low, -score, owner))
    own, at = owner[order], np.arange(len(order))
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k] if len(own) else order


def _best(k: int, held: int = 32):
    """Each query's best ``k`` vectors of a list, over the blocks that the task meets in a row.

    The best of at most ``held`` query blocks are kept open; what is given out early only
    leaves more candidates.
    """
    names = ["key", "vec_key", "score", "ids"]

    def pair(asks, rows):
        q, x = _matrix(asks.field("vec")), _matrix(rows.field("vec"))
        ids = rows.field("ids")
        low = np.array([v[0].as_py() for v in ids], dtype=np.int64)
        approximate = q @ x.T
        if len(x) > k:   # all that reach the k-th best, ties included; the margin covers rounding
            margin = 1e-10 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            least = np.partition(approximate, len(x) - k, axis=1)[:, len(x) - k] - margin
            near = [np.flatnonzero(row >= at_least) for row, at_least in zip(approximate, least)]
        else:
            near = [np.arange(len(x))] * len(q)
        owner, place = np.repeat(np.arange(len(q)), [len(at) for at in near]), np.concatenate(near)
        score = np.concatenate([np.add.reduce(np.ascontiguousarray(x[at] * vec), axis=1) for vec, at in zip(q, near)])
        best = _top(owner, score, low[place], k)
        owner, place = owner[best], place[best]
        return pa.table([pa.array(owner), pa.array(low[place]), asks.field("key").take(pa.array(owner)),
                         rows.field("key").take(pa.array(place)), pa.array(score[best]), ids.take(pa.array(place))],
                        ["owner", "low", *names])

    def run(batches):
        open_: dict = {}

        def given(key):
            yield from open_.pop(key).select(names).combine_chunks().to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                new = pair(batch.column(2)[i].values, batch.column(3)[i].values)
                if key in open_:
                    both = pa.concat_tables([open_[key], new])
                    best = _top(*(both.column(c).to_numpy() for c in ("owner", "score", "low")), k)
                    open_[key] = both.take(pa.array(best))
                else:
                    open_[key] = new
                    if len(open_) > held:
                        yield from given(next(iter(open_)))
        for key in list(open_):
            yield from given(key)

    return run
