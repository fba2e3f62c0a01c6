"""Benchmark decontamination by greedy string tiling.

Seeds are the five-word windows of the benchmark items. A bit table of fixed size (which
seeds' hashes occur) goes to every task; a task keeps, of a whole text, only the windows whose
hash hits it. Spark joins these with the seeds, so any benchmark size works.

A pair is compared only if it can reach the coverage that counts: a tile of ``L`` windows covers
``L + 4`` words, at most five a window, so covering ``threshold`` of an item of ``W`` words takes
at least ``threshold * W / 5`` of its windows. All but one less than that, the rarest ones by the
documents that hold them, index the item; a pair that shares none of these can't reach the
threshold. So a stem that all items and documents share pairs nothing by itself. Pairs that are
found get all their shared windows, and those with too few are dropped.

The windows are gathered per document and item. There, running Karp-Rabin finds the longest common run of words that
is still unmarked, marks it on both sides, and goes on with shorter ones, down to one seed.
The marked share of the item is its coverage: it doesn't depend on the order in which the
document holds the pieces, so passages put in another order count in full. A document that
covers ``threshold`` of an item is contaminated.

Windows of a document are kept as positions by seed, not as pairs of positions, so repeated
passages cost their length, not its square.

Defined cases: null and empty texts, and items of fewer than ``SEED_WORDS`` words, match
nothing; repeated documents (equal ids included) are each judged; repeated items with one id
count as alternatives of that item; with an empty benchmark every document is clean. Texts of any
length are tiled whole; columns beside the id and text may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, free_name, per_batch, staged, words

SEED_WORDS = 5
TABLE_BITS = 1 << 23
THRESHOLD = 0.5


def window_hashes(tokens: list[str], n: int = SEED_WORDS, cache: dict | None = None) -> np.ndarray:
    """Running Karp-Rabin hashes (modulo 2^64, mixed) of all windows of ``n`` words."""
    if len(tokens) < n:
        return np.empty(0, dtype=np.uint64)
    if cache is None:
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
    else:
        h = np.array([cache[t] for t in tokens], dtype=np.uint64)
    return rolling(h, n)


def rolling(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` symbols, from running sums of base powers."""
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    k = len(symbols) - n + 1
    out = np.zeros(max(k, 0), dtype=np.uint64)
    if k > 0:
        if n <= 8:
            for j in range(n):
                out = out * base + symbols[j:j + k]
        else:  # double the window as often as it fits, then join two overlapping-free parts
            parts, size, cur = [], 1, symbols
            todo, at = n, 0
            while todo:
                if todo & 1:
                    parts.append((cur, size, at))
                    at += size
                todo >>= 1
                if todo:
                    cur, size = cur[:len(cur) - size] * _power(base, size) + cur[size:], size * 2
            for cur, size, at in parts:
                out = out * _power(base, size) + cur[at:at + k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class WordHashes(dict):
    """Word -> hash; forgotten as a whole when it grows past ``MOST`` words."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def seeds_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, part, n_words, pos, seed): every window of every item; ``part`` parts items of one id."""

    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                h = _signed(window_hashes(w))
                part = int(_signed(np.array([xxhash.xxh3_64_intdigest(" ".join(w))], dtype=np.uint64))[0])
                for c, v in zip(cols, ([item] * len(h), [part] * len(h), [len(w)] * len(h), range(len(h)), h.tolist())):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                ["item_id", "part", "n_words", "pos", "seed"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return per_batch(rows, run, "item_id long, part long, n_words int, pos int, seed long").distinct()


def seed_table(seeds: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Bit table of the seeds' hashes: at most ``bits`` places come to the driver, whatever the benchmark's size."""
    slots = seeds.select(F.pmod("seed", F.lit(bits)).cast("int").alias("slot")).distinct().toPandas()["slot"]
    table = np.zeros(bits, dtype=bool)
    table[slots.to_numpy(dtype=np.int64)] = True
    return np.packbits(table)


def document_windows(docs: DataFrame, table: np.ndarray, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, seed, places): each row's windows that hit the table; ``key`` is a hash of id and text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)  # bits / 8 bytes
    cache = WordHashes()

    def run(batches):
        flags = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            ids, keys, seeds, places = [], [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                w = words(text.as_py())
                if len(w) < SEED_WORDS:
                    continue
                h = window_hashes(w, cache=cache)
                at = np.flatnonzero(flags[_signed(h) % bits])
                if not len(at):
                    continue
                order = at[np.argsort(h[at], kind="stable")]
                hits = h[order]
                cut = np.flatnonzero(np.r_[True, hits[1:] != hits[:-1]])
                ids += [doc] * len(cut)
                keys += [key] * len(cut)
                seeds += _signed(hits[cut]).tolist()
                places += [p.tolist() for p in np.split(order, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(seeds, pa.int64()),
                                              pa.array(places, pa.list_(pa.int32()))], ["id", "key", "seed", "places"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"),
                       F.col(text_col).alias("text"))
    return per_batch(rows, run, "id long, key long, seed long, places array<int>")


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def tiles(doc_seeds: list, doc_places: list, item_places: list, n: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one document and one item, from their shared seeds.

    The arrays give each shared seed's positions on both sides. Returns (document position,
    item position, words) of the tiles, longest first, leftmost in the item on ties.
    """
    a, a_at = _sequence(doc_seeds, doc_places)
    b, b_at = _sequence(doc_seeds, item_places)
    out = []
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    longest = None
    while True:
        longest, ia, ib = _longest(a, a_at, free_a, b, b_at, free_b, longest)
        if not longest:
            return out
        # of this length, every match that is still free on both sides, in the item's order
        lookup: dict[int, list[int]] = {}
        for h, p in zip(*ia):
            lookup.setdefault(h, []).append(p)
        for h, q in zip(*ib):
            if not free_b[q:q + longest].all():
                continue
            places = lookup.get(h, [])
            while places:
                p = places[0]
                if free_a[p:p + longest].all():
                    out.append((int(a_at[p]), int(b_at[q]), longest + n - 1))
                    _mark(free_a, a_at, p, longest, n)
                    _mark(free_b, b_at, q, longest, n)
                    break
                places.pop(0)


def _sequence(seeds, places) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([np.asarray(p, dtype=np.int64) for p in places])
    symbol = np.repeat(np.asarray(seeds, dtype=np.int64).view(np.uint64), [len(p) for p in places])
    order = np.argsort(at, kind="stable")
    return symbol[order], at[order]


def _mark(free: np.ndarray, at: np.ndarray, p: int, length: int, n: int) -> None:
    """Take the windows that share a word with the tile of ``length`` windows from place ``p``."""
    a, b = np.searchsorted(at, at[p] - n + 1), np.searchsorted(at, at[p + length - 1] + n - 1, side="right")
    free[a:b] = False


def _windows(symbols, at, free, length) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the runs of ``length`` neighbouring free windows."""
    h = rolling(symbols, length)
    if not len(h):
        return h, np.empty(0, np.int64)
    taken = np.r_[0, np.cumsum(~free)]
    k = len(h)
    ok = (at[length - 1:] - at[:k] == length - 1) & (taken[length:] == taken[:k])
    place = np.flatnonzero(ok)
    return h[place], place


def _longest(a, a_at, free_a, b, b_at, free_b, most):
    """The longest common run of free windows, by bisection over its length."""
    low, high, best = 0, min(len(a), len(b), most or 1 << 30), None
    while low < high:
        mid = (low + high + 1) // 2
        ha, pa_ = _windows(a, a_at, free_a, mid)
        hb, pb = _windows(b, b_at, free_b, mid)
        ka, kb = np.isin(ha, hb), np.isin(hb, ha)
        if ka.any():
            low, best = mid, ((ha[ka].tolist(), pa_[ka].tolist()), (hb[kb].tolist(), pb[kb].tolist()))
        else:
            high = mid - 1
    return (low, *best) if best else (0, None, None)


PAIR = "id long, key long, item_id long, n_tiles int, longest int, covered int, n_words int, coverage double"


def least_windows(n_words, least: float):
    """Windows of an item of ``n_words`` words (a column) that a coverage of ``least`` takes; at least one."""
    return F.greatest(F.lit(1), F.ceil(n_words * F.lit(least / SEED_WORDS) - 1e-9))


def rarest_windows(item_seeds: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(seed, item_id, part): the windows of each item that every document covering ``least`` of it shares one of.

    Of an item's windows, the ``least_windows - 1`` that most documents hold are left out, and those that none holds.
    """
    held = found.groupBy("seed").agg(F.count("*").alias("held"))
    ranked = item_seeds.join(held, "seed").select("item_id", "part", "n_words", "seed", "held", F.size("at").alias("times"))
    upto = Window.partitionBy("item_id", "part", "n_words").orderBy(F.desc("held"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.withColumn("upto", F.sum("times").over(upto)).where(F.col("upto") >= least_windows(F.col("n_words"), least))
            .select("seed", "item_id", "part"))


def coverage(docs: DataFrame, items: DataFrame, bits: int = TABLE_BITS, id_col: str = "doc_id", text_col: str = "text",
             item_id: str = "item_id", item_text: str = "text", least: float = 0.0) -> DataFrame:
    """Per document (its id, and ``row_key``) and item: the tiles' coverage of the item.

    Holds every pair whose coverage is ``least`` or more, and may hold others with a shared seed; with 0, all of these.
    """
    seeds = staged(seeds_of(items, item_id, item_text), "tile-seeds")
    table = seed_table(seeds, bits)
    found = staged(document_windows(docs, table, bits, id_col, text_col).dropDuplicates(["key", "seed"]),  # repeated rows count once
                   "tile-found")
    item_seeds = staged(seeds.groupBy("item_id", "part", "n_words", "seed").agg(F.collect_list("pos").alias("at")), "tile-items")
    index = broadcast_if_small(staged(rarest_windows(item_seeds, found, least), "tile-index"))
    met = found.select("key", "seed").join(index, "seed").select("key", "item_id", "part").distinct()
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  (a null id is an item, too)
    item = F.concat_ws(":", one("item_id"), "part")
    whole = broadcast_if_small(item_seeds.withColumn("item", item))
    wanted = met.select("key", item.alias("item")).join(whole, "item").drop("item")
    pairs = (found.join(wanted, ["key", "seed"]).groupBy("id", "key", "item_id", "part", "n_words").agg(
        F.collect_list(F.struct("seed", "places", "at")).alias("hits"), F.sum(F.size("at")).alias("windows"))
        .where(F.col("windows") >= least_windows(F.col("n_words"), least)))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, key, item, n_words, hits in zip(*(batch.column(c).to_pylist() for c in (
                    "id", "key", "item_id", "n_words", "hits"))):
                t = tiles([x["seed"] for x in hits], [x["places"] for x in hits], [x["at"] for x in hits])
                covered = sum(x[2] for x in t)
                rows.append((doc, key, item, len(t), max(x[2] for x in t), covered, n_words, covered / n_words))
            cols = list(zip(*rows)) if rows else [[]] * len(_PAIR_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PAIR_SCHEMA)], schema=_PAIR_SCHEMA)

    return per_batch(pairs.select("id", "key", "item_id", "n_words", "hits"), run, PAIR)


_PAIR_SCHEMA = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("longest", pa.int32()),
                          ("covered", pa.int32()), ("n_words", pa.int32()), ("coverage", pa.float64())])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per contaminated document: id, key, n_items (items covered to ``threshold``), best_item and its coverage."""
    pairs = coverage(docs, items, least=threshold, **options).where(F.col("coverage") >= threshold)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("m"), "n_tiles")).alias("best")
    return (pairs.groupBy("id", "key").agg(F.countDistinct("item_id").alias("n_items"), best)
            .select("id", "key", "n_items", (-F.col("best.m")).alias("best_item"), F.col("best.coverage").alias("coverage"),
                    F.col("best.n_tiles").alias("n_tiles")))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept.

    Rows are matched by a hash of id and text, so equal or null ids don't drag others along.
    """
    key = free_name(docs, "_bad")
    bad = contaminated(docs, items, threshold, id_col=id_col, text_col=text_col, **options).select(F.col("key").alias(key))
    bad = broadcast_if_small(staged(bad, "tile-bad"))
    return (docs.join(bad, row_key(id_col, text_col) == F.col(key), "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
