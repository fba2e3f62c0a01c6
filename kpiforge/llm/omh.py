"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's k-mers are its five-word windows, each labelled with its occurrence, so that a
repeated window counts as often as it occurs. A sketch takes the ``PICK`` k-mers with the
smallest hashes and keeps them in text order: two texts agree on it if they share these k-mers
*and* their order, which follows edit similarity closer than the set does. Each of ``SKETCHES``
sketches deals the texts into buckets.

Candidates: a bucket's most central text (the one in the largest buckets) is compared with the
others of the bucket, so a group of copies costs its size, not its square. Buckets that still
hold texts of several components go on with centres drawn anew, as long as that joins many
texts. What stays mixed is finished exactly: all pairs of different components in a bucket, in
blocks of ``BLOCK`` texts, counted over shared labelled k-mers and aligned where the count allows
it. So the classes are those of comparing all pairs inside all buckets.

Verification: the shared labelled k-mers within a band around the diagonal are aligned (longest
chain that rises in both texts); similarity is the aligned k-mers over all k-mers of both, and
``SIMILARITY`` or more is a link. Classes are the connected components of the links.

Equal texts are one node with many rows. Only nodes are sketched, compared and linked.

Defined cases: a null text is an empty one; texts of fewer than five words are in a class with
equal texts only; a class's id is its smallest document id, null if it has none; repeated rows
are rows of one class; empty tables give empty results. Texts of any length are taken whole, and
columns beside the id and text may have any name.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, free_name, per_batch, release, ship_package, staged, words
from kpiforge.llm.tiling import WordHashes, rolling

K = 5
PICK = 3
SKETCHES = 16
SIMILARITY = 0.8
SEED = 20240229
#: Texts of a block in the exact finish, and the share of mixed texts that a round of centres must join for another.
BLOCK = 128
WORTHWHILE = 0.1
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, size=SKETCHES, dtype=np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- one text

def labelled_kmers(tokens: list[str], cache: WordHashes) -> np.ndarray:
    """Hashes of the windows of ``K`` words in text order, each with its occurrence number mixed in."""
    if len(tokens) < K:
        return np.empty(0, dtype=np.uint64)
    k = rolling(np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens)), K)
    order = np.argsort(k, kind="stable")
    ranked = k[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if not first.all():
        at = np.arange(len(k))
        occurrence = np.empty(len(k), dtype=np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        k = k + occurrence * np.uint64(0xD6E8FEB86659FD93)
    return k


def sketches(kmers: np.ndarray) -> np.ndarray:
    """The ``SKETCHES`` hashes of the smallest k-mers in text order (all k-mers of a shorter text)."""
    if len(kmers) <= PICK:
        pick = np.broadcast_to(np.arange(len(kmers)), (SKETCHES, len(kmers)))
    else:
        x = kmers[None, :] * _MULTIPLIERS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        pick = np.sort(np.argpartition(x, PICK - 1, axis=1)[:, :PICK], axis=1)
    out = np.full(SKETCHES, 17, dtype=np.uint64)
    for j in range(pick.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + kmers[pick[:, j]]
        out ^= out >> np.uint64(31)
    return out


def alignment(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common chain of labelled k-mers that stays within ``band`` of the diagonal."""
    order = np.argsort(a, kind="stable")
    place = np.minimum(np.searchsorted(a, b, sorter=order), len(a) - 1)
    i = order[place]
    j = np.flatnonzero((a[i] == b) & (np.abs(i - np.arange(len(b))) <= band))
    tails: list[int] = []
    for x in i[j].tolist():
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
        else:
            tails[p] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of both texts; 0 where lengths alone keep it below ``least``."""
    short, long = sorted((len(a), len(b)))
    if not short or short < least * long:
        return 0.0
    common = alignment(a, b, int((1 - least) * long) + 1)
    return common / (short + long - common)


# ---------------------------------------------------------------- nodes and candidates

def node_of(text: Column) -> Column:
    """A text's node: equal texts share it."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, n, sketch) per row; ``sketch`` is null for texts of fewer than ``K`` words."""
    cache = WordHashes()

    def run(batches):
        for batch in batches:
            n, out = [], []
            for text in batch.column(2):
                kmers = labelled_kmers(words(text.as_py()), cache)
                n.append(len(kmers))
                out.append(sketches(kmers).view(np.int64) if len(kmers) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                ["id", "node", "n", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), node_of(F.col(text_col)).alias("node"),
                       F.col(text_col).alias("text"))
    return per_batch(rows, run, "id long, node binary, n int, sketch array<long>")


def _dealt(nodes: DataFrame) -> DataFrame:
    """``nodes`` once for each sketch ``k``, with its bucket."""
    hashes = F.array(*(F.xxhash64(F.lit(k), F.col("sketch")[k]) for k in range(SKETCHES)))
    return nodes.select("node", "n", F.posexplode(hashes).alias("k", "bucket"))


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one label."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1")
    return members.join(mixed.select("bucket"), "bucket", "left_semi")


def _candidates(members: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b): each bucket's centre with its members of another label.

    The centre is the most central text in turn 0, else one drawn anew for each turn and bucket.
    """
    by = F.xxhash64(F.lit(turn), "bucket", "node") if turn else F.col("pop")
    top = members.groupBy("bucket").agg(F.max(F.struct(by.alias("by"), "node", "n", "label")).alias("top"))
    near = F.least("n", "top.n") >= F.lit(SIMILARITY) * F.greatest("n", "top.n")
    return (members.join(top, "bucket").where((F.col("label") != F.col("top.label")) & near)
            .select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct())


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that banded alignment finds similar."""
    t = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "text_a", "text_b")
    cache = WordHashes()

    def run(batches):
        for batch in batches:
            last, keep = (None, None), []
            nodes = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for k in sorted(range(len(nodes)), key=nodes.__getitem__):  # a centre's k-mers are made once
                if last[0] != nodes[k][0]:
                    last = nodes[k][0], labelled_kmers(words(batch.column(2)[k].as_py()), cache)
                if similarity(last[1], labelled_kmers(words(batch.column(3)[k].as_py()), cache)) >= SIMILARITY:
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return per_batch(both, run, "a binary, b binary")


def linked_pairs(kmers: list[np.ndarray], labels: list, sketch: np.ndarray, side: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Similar pairs that join the labels of a block as comparing all its pairs would.

    Pairs of one side (other than 0) or with an earlier common sketch than ``k`` belong to another
    block. The count of shared labelled k-mers, which no alignment exceeds, rules out the others.
    """
    m, n = len(kmers), np.array([len(x) for x in kmers])
    ids = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
    least = SIMILARITY / (1 + SIMILARITY) * (n[:, None] + n[None, :]) - 1e-6
    open_ = np.triu((ids[:, None] != ids[None, :]) & (np.minimum(n[:, None], n[None, :]) >= least), 1)
    open_ &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
    for j in range(k):
        open_ &= sketch[:, None, j] != sketch[None, :, j]
    if not open_.any():
        return []
    owner, flat = np.repeat(np.arange(m), n), np.concatenate(kmers)
    order = np.lexsort((owner, flat))
    owner, flat = owner[order], flat[order]
    shared = np.zeros(m * m, dtype=np.int64)
    at, step = np.arange(len(flat)), 1
    while len(at):  # pairs of owners at a distance of ``step`` in a k-mer's run
        at = at[at < len(flat) - step]
        at = at[flat[at] == flat[at + step]]
        shared += np.bincount(owner[at] * m + owner[at + step], minlength=m * m)
        step += 1
    root, out = list(range(int(ids.max()) + 1)), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    shared = shared.reshape(m, m)
    ii, jj = np.nonzero(open_ & (shared >= least))
    for t in np.argsort(-shared[ii, jj], kind="stable").tolist():
        i, j = int(ii[t]), int(jj[t])
        a, b = find(ids[i]), find(ids[j])
        if a != b and similarity(kmers[i], kmers[j]) >= SIMILARITY:
            root[a] = b
            out.append((i, j))
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """(grp, side, node, label, k): every two blocks of a mixed bucket as a group.

    A label with ``BLOCK`` members or more in a bucket has blocks of its own, which aren't paired with one another.
    """
    sizes = staged(members.groupBy("bucket", "label").agg(F.count("*").alias("size")), "omh-sizes")
    large = F.col("size") >= BLOCK
    few = sizes.groupBy("bucket").agg(F.sum(F.when(large, 0).otherwise(F.col("size"))).alias("few"))
    parts = F.greatest(F.lit(1), F.ceil(F.when(large, F.col("size")).otherwise(F.col("few")) / BLOCK))
    dealt = staged(members.join(sizes, ["bucket", "label"]).join(few, "bucket").select(
        "bucket", "k", "node", "label", F.when(large, F.col("label")).otherwise(F.lit(b"")).alias("own"),
        F.pmod(F.xxhash64(F.when(large, F.col("node")).otherwise(F.col("label"))), parts).alias("part")), "omh-dealt")
    blocks = staged(dealt.select("bucket", "own", "part").distinct(), "omh-blocks")
    x, y = (blocks.select("bucket", F.struct("own", "part").alias(s)) for s in "xy")
    two = (x.join(y, "bucket").where("x <= y AND (x.own != y.own OR x.own = X'')")
           .withColumn("grp", F.xxhash64("bucket", "x.own", "x.part", "y.own", "y.part")))
    sides = (two.select("bucket", "x.own", "x.part", "grp", F.when(F.expr("x = y"), 0).otherwise(1).alias("side"))
             .union(two.where("x != y").select("bucket", "y.own", "y.part", "grp", F.lit(2))))
    return dealt.join(sides, ["bucket", "own", "part"]).select("grp", "side", "node", "label", "k")


def _finished(members: DataFrame, sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the labels of the mixed buckets as comparing all their pairs would."""
    ship_package(members.sparkSession)
    rows = _blocks(members).join(texts.join(sketched.select("node", "sketch"), "node"), "node")

    def run(table: pa.Table) -> pa.Table:
        release()
        cache, nodes = WordHashes(), table.column("node").to_pylist()
        kmers = [labelled_kmers(words(t.as_py()), cache) for t in table.column("text")]
        pairs = linked_pairs(kmers, table.column("label").to_pylist(), np.array(table.column("sketch").to_pylist()),
                             table.column("side").to_numpy(), table.column("k")[0].as_py())
        return pa.table([pa.array([min(nodes[i], nodes[j]) for i, j in pairs], pa.binary()),
                         pa.array([max(nodes[i], nodes[j]) for i, j in pairs], pa.binary())], ["a", "b"])

    return rows.groupBy("grp").applyInArrow(run, "a binary, b binary")


def links(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) with the components of all similar pairs in a bucket. ``signed``: ``signatures(docs)``, staged."""
    sketched = staged(signed.where("sketch IS NOT NULL").groupBy("node")
                      .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("id").alias("rep")), "omh-nodes")
    dealt = _dealt(sketched)
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    dealt = staged(dealt.join(sizes, "bucket"), "omh-dealt")  # texts that share a bucket
    pop = staged(dealt.groupBy("node").agg(F.sum("size").alias("pop")), "omh-central")
    members = dealt.drop("size").join(pop, "node").withColumn("label", F.col("node"))

    wanted = broadcast_if_small(staged(sketched.join(pop, "node", "left_semi").select(F.col("node").alias("w_node"), "rep"),
                                       "omh-wanted"), 200_000)
    texts = docs.select(node_of(F.col(text_col)).alias("node"), F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).alias("text"))
    texts = staged(texts.join(wanted, (F.col("node") == F.col("w_node")) & F.col("id").eqNullSafe(F.col("rep")))
                   .select("node", "text").dropDuplicates(["node"]), "omh-texts")

    found, turn = staged(verified(_candidates(members, 0), texts), "omh-links"), 0
    while True:
        roots = components(found).withColumnRenamed("node", "linked")
        members = staged(_mixed(members.join(roots, F.col("node") == F.col("linked"), "left")
                                .withColumn("label", F.coalesce("root", "node")).drop("linked", "root")), "omh-mixed")
        mixed = members.agg(F.count_distinct("label")).first()[0]
        if turn and new.count() < WORTHWHILE * mixed or not mixed:
            break
        turn += 1
        new = staged(verified(_candidates(members, turn), texts), "omh-links")
        found = staged(found.union(new), "omh-links")
    return found.union(staged(_finished(members, sketched, texts), "omh-links")) if mixed else found


# ---------------------------------------------------------------- classes

def components(pairs: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars.

    Each round joins every edge with its end's smallest neighbour; no group is gathered.
    """
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(),
                   "cc-edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = staged(large, "cc-large")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(low, "u")
        small = (tied.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(tied.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        edges = staged(small, "cc-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, node, root (its class) and class_id (the class's smallest id)."""
    signed = staged(signatures(docs, id_col, text_col), "omh-signed")
    roots = components(links(signed, docs, id_col, text_col)).withColumnRenamed("node", "linked")
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"))
    nodes = staged(nodes.join(roots, F.col("node") == F.col("linked"), "left")
                   .select("node", "rep", F.coalesce("root", "node").alias("root")), "omh-roots")
    least = nodes.groupBy("root").agg(F.min("rep").alias("class_id"))
    return signed.select("id", "node").join(nodes.join(least, "root").select("node", "root", "class_id"), "node")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash; all columns kept."""
    classes = staged(near_duplicates(docs, id_col, text_col), "omh-classes")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("node"))
    best = classes.groupBy("root").agg(F.min(rank).alias("best"))
    judged = classes.join(best, "root").withColumn("stays", rank == F.col("best"))
    judged = staged(judged.groupBy("id", "node").agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
                    .where("NOT stays OR rows > 1"), "omh-judged")
    row = (F.col(f"`{id_col}`").cast("long"), node_of(F.col(f"`{text_col}`")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    j_id, j_node = free_name(docs, "_j_id"), free_name(docs, "_j_node")

    def match(side: DataFrame, how: str) -> DataFrame:
        side = broadcast_if_small(side.select(F.col("id").alias(j_id), F.col("node").alias(j_node)), 200_000)
        return docs.join(side, row[0].eqNullSafe(F.col(j_id)) & (row[1] == F.col(j_node)), how)

    again = judged.where("stays")  # the row that stays occurs more than once: all but one of its equals go
    kept = match(judged, "left_anti").select(*columns)
    if again.limit(1).count():
        same = match(again, "left_semi")
        kept = kept.union(same.withColumn(j_node, row[1]).withColumn(j_id, row[0])
                          .dropDuplicates([j_id, j_node]).select(*columns))
    return kept
