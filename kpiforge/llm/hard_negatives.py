"""Hard negatives by exact integer scores, multiplied in a residue number system.

Each component ``x`` becomes the integer ``floor(256 * x)``. A score is the integer inner product of
a row and an anchor. Blocks of anchors and rows are multiplied as float32 matrices modulo several
small primes: centred residues are so small that every partial sum is an integer under 2^24, so the
products are exact in any order. Mixed-radix digits (the Chinese remainder theorem in steps) give
the signed scores back; there are as many primes as the blocks' norms need.

Two passes over the same grid of blocks: the first finds each anchor's ``positives`` best rows of
its own label; the second, for each positive, the best rows of other labels whose score lies between
``low`` and ``high`` hundredths of the positive's. A cell of the grid keeps only what can be among
the best, and window functions select over the cells. All anchors meet all rows, in blocks of fixed
size; rows are dealt by row number, so equal ids or vectors don't meet in one task.

Defined cases: rows without id or label, and vectors that are null or hold null or non-finite
components, take no part; vectors of unequal length are compared as if filled with zeros, an empty
one scores 0. Rows are "other" rows if their id differs from the anchor's; repeated rows all take
part, repeated equal anchors count once, and rows that tie in score and id come in any order. An
anchor without others of its label, or a positive without rows in its range, has no result.
Vectors longer than 2^31 once scaled are refused with an error, as scores might leave a long. Only
the named columns are read; others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import ship_package, staged

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
DEPTH = 256               # components per product
EXACT = 1 << 24           # float32 holds all integers up to here
STRIP_ROWS, BLOCK_ANCHORS, CHUNK_ROWS = 16_384, 1_024, 4_096
LONGEST = 1 << 31


# ---------------------------------------------------------------- exact products

def small_primes() -> list[int]:
    """Primes, largest first, whose centred residues keep ``DEPTH`` products under ``EXACT``."""
    most = 2 * int((EXACT // DEPTH) ** 0.5)
    return [p for p in range(most, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all integers from ``-bound`` to ``bound`` apart."""
    out, product = [], 1
    for p in small_primes():
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residues of smallest size."""
    return (x + p // 2) % p - p // 2


def norm_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No score of a row of ``a`` and a row of ``b`` is larger in size."""
    longest = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) for x in (a, b)]
    return int(longest[0] * longest[1] * 1.001) + 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact in int64."""
    primes = primes_for(norm_bound(a, b))
    digits: list[np.ndarray] = []
    score, weight = np.zeros((len(a), len(b)), dtype=np.int64), 1
    for k, p in enumerate(primes):
        total = np.zeros((len(a), len(b)), dtype=np.float32)
        for d in range(0, a.shape[1], DEPTH):
            part = centred(a[:, d:d + DEPTH], p).astype(np.float32) @ centred(b[:, d:d + DEPTH], p).astype(np.float32).T
            total = centred(total + centred(part, p), p)
        digit = total.astype(np.int64)
        for earlier, q in zip(digits, primes):   # peel off the digits known so far, then divide by their prime
            digit = centred((digit - earlier) * pow(q, -1, p), p)
        digits.append(digit)
        score += digit * np.uint64(weight).astype(np.int64)   # modulo 2^64: exact, as the score fits a long
        weight = weight * p % (1 << 64)
    return score


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integer components, filled with zeros to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), dtype=np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` largest scores that fit; columns are in the order that breaks ties."""
    least = np.iinfo(np.int64).min
    held = np.where(fits, score, least)
    if held.shape[1] > k:   # what reaches the k-th best, ties included
        fits = fits & (held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None])
    rows, cols = np.nonzero(fits)
    order = np.lexsort((cols, -held[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


# ---------------------------------------------------------------- the grid

def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, relabel=None) -> DataFrame:
    """Rows that take part, staged: id, label, v (integers), row."""
    v, x = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    label = F.col(f"`{label_col}`").cast("long")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    own = df.where(x.isNotNull() & label.isNotNull() & v.isNotNull() & finite).select(
        x.cast("long").alias("id"), (relabel(x, label) if relabel else label).alias("label"),
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))
    return staged(own, "negatives-rows").withColumn("row", F.monotonically_increasing_id())


def _grid(anchors: DataFrame, rows: DataFrame, n_blocks: int, n_strips: int, run, schema: str) -> DataFrame:
    """``run`` over every block of anchors with every strip of rows."""
    ship_package(rows.sparkSession)
    left = anchors.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1))))
    right = rows.withColumn("strip", (F.col("row") % n_strips).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInArrow(run, schema)


def _scored(anchors: pa.Table, rows: pa.Table, width: int):
    """Chunks of a cell: ids and labels of both sides, scores, and the anchors' table places."""
    rows = rows.sort_by("id")
    a = matrix(anchors.column("v"), width)
    for start in range(0, len(rows), CHUNK_ROWS):
        chunk = rows.slice(start, CHUNK_ROWS)
        ids, labels = (chunk.column(c).to_numpy() for c in ("id", "label"))
        yield ids, labels, products(a, matrix(chunk.column("v"), width))


def mine(df: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` maps the id column to a condition; ``relabel`` maps id and label columns to the
    label to use. The number of blocks follows the numbers of rows and anchors.
    """
    rows = usable(df, id_col, vector_col, label_col, relabel)
    anchors = staged(rows.where(is_anchor(F.col("id"))).dropDuplicates(["id", "label", "v"]), "negatives-anchors")
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c)
    n_rows, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(square))).first()
    if (most or 0) >= LONGEST:
        raise ValueError(f"a scaled vector of length {most} is beyond {LONGEST}: scores might not fit a long")
    n_strips, n_blocks = max(1, -(-n_rows // STRIP_ROWS)), max(1, -(-anchors.count() // BLOCK_ANCHORS))
    width = max(width or 0, 1)
    anchors = anchors.select("id", "label", "v", F.col("row").alias("anchor"), F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    kept = rows.select("id", "label", "v", "row")

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, anchor = (left.column(c).to_numpy() for c in ("id", "label", "anchor"))
        out = [(np.empty(0, np.int64),) * 4]
        if len(left) and len(right):
            for r_ids, r_labels, score in _scored(left, right, width):
                fits = (labels[:, None] == r_labels[None]) & (ids[:, None] != r_ids[None])
                i, j = best(score, fits, positives)
                out.append((anchor[i], ids[i], r_ids[j], score[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "anchor_id", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = _grid(anchors, kept, n_blocks, n_strips, find_positives, "anchor long, anchor_id long, positive_id long, positive_score long")
    found = staged(found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives), "negatives-positives")

    ranges = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    targets = staged(anchors.join(ranges, "anchor").select("id", "label", "v", "anchor", "block", F.transform("p", lambda x: x["positive_score"]).alias("scores")),
                     "negatives-targets")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        labels, anchor = (left.column(c).to_numpy() for c in ("label", "anchor"))
        scores = left.column("scores").to_pylist()
        out = [(np.empty(0, np.int64),) * 4]
        if len(left) and len(right):
            for r_ids, r_labels, score in _scored(left, right, width):
                other = labels[:, None] != r_labels[None]
                for nth in range(positives):
                    own = np.array([k for k, s in enumerate(scores) if len(s) > nth], dtype=np.int64)
                    if not len(own):
                        break
                    p = np.array([scores[k][nth] for k in own])[:, None]
                    least, top = -(-low * p // 100), high * p // 100   # 100 * score within low * p and high * p
                    i, j = best(score[own], other[own] & (score[own] >= least) & (score[own] <= top), negatives)
                    out.append((anchor[own[i]], np.full(len(i), nth + 1), r_ids[j], score[own[i], j]))
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["anchor", "nth", "negative_id", "negative_score"])

    second = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id")
    met = _grid(targets, kept, n_blocks, n_strips, find_negatives, "anchor long, nth long, negative_id long, negative_score long")
    met = met.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= negatives)
    return met.join(found.withColumn("nth", F.col("nth").cast("long")), ["anchor", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
