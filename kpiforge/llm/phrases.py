"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of a document. A window repeats when its words also start in
a document with a smaller id; words that repeating windows cover are removed. All windows are judged
on the input.

1. Candidates. Each window is put down under its seed, the ``SEED`` words in it with the least hash:
   equal windows have equal seeds. Consecutive windows of one seed are a segment, and equal segments
   are one row with their first and last document, so a passage that many documents hold is small.
2. Confirmed passages. Where a seed has one segment, in several documents, all its windows recur.
   Where it has more (the edges of passages, edited copies), the windows of the distinct segments
   are compared one by one. Runs of recurring windows in the first document that holds them are the
   passages.
3. Automata. Passages are dealt to shards of ``SHARD_WORDS`` words. A shard numbers its words, and an
   Aho-Corasick automaton holds a phrase of ``PHRASE`` words at every ``STRIDE``-th word of each
   passage: every window of the passage holds one of them.
4. Search. Documents go to the shards that hold passages of theirs, many tasks to a shard, and stream
   through the automaton. The windows around each found phrase are looked up among the shard's
   passages and compared word by word, so no hash decides alone.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none, and texts of fewer
than ``WINDOW`` words have no window. Very long texts are worked on whole, one at a time. Rows of one
id are not smaller than each other; equal rows get equal results; rows without id neither lose words
nor make others lose any. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, per_batch, ship_package, staged

WINDOW, SEED = 50, 8
PHRASE = 10
STRIDE = WINDOW - PHRASE + 1
GRAMS = WINDOW - SEED + 1            # seeds to choose from in a window
DIGITS = 3
SLICE_WORDS = 200_000                # words worked on at a time (or one document)
SHARD_WORDS, SPLIT_WINDOWS = 400_000, 100_000
TASK_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15            # odd, so that it can be divided by modulo 2^64
UNBASE = pow(BASE, -1, 1 << 64)


# ---------------------------------------------------------------- hashes of words and windows

def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []   # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any run of words, from sums of hashes times powers (modulo 2^64)."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = np.full(n, BASE, np.uint64), np.full(n + 1, UNBASE, np.uint64)
        up[:1] = self.down[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * np.cumprod(up), out=self.sums[1:])
        self.down = np.cumprod(self.down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def segments(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of documents of so many words, laid end to end: document, first and last window start, seed, hash."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes))
    starts = place[place + WINDOW <= ends[doc]] if len(hashes) else place
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    rolling = Rolling(hashes)
    grams = rolling.of(place[:len(hashes) - SEED + 1], place[SEED - 1:] + 1)
    # The least of the high halves; the low half is the place, so that the first of equals is taken.
    least, width = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= GRAMS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    seed_at = (np.minimum(least[starts], least[starts + GRAMS - width]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, seed_at[1:] != seed_at[:-1]])
    last = np.r_[first[1:], len(starts)] - 1
    a, b = starts[first], starts[last]
    return (doc[a], a - begins[doc[a]], b - begins[doc[a]], grams[seed_at[first]].view(np.int64),
            rolling.of(a, b + WINDOW).view(np.int64))


def window_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return Rolling(hashes).of(starts, starts + WINDOW).view(np.int64)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) put together where they touch or overlap, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---------------------------------------------------------------- one shard

class Shard:
    """Passages with the ids of the documents that hold them first, and the automaton of their phrases."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        self.codes: dict[bytes, int] = {}
        for _, words in passages:
            for w in words:
                if w not in self.codes:
                    self.codes[w] = len(self.codes) + 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        numbers = [self.numbers(words) for _, words in passages]
        for own in numbers:
            text = spelled(own)
            for at in range(0, len(own) - PHRASE + 1, STRIDE):
                self.automaton.add_word(text[DIGITS * at:DIGITS * (at + PHRASE)])
        self.automaton.make_automaton()
        self.words = np.concatenate(numbers)
        sizes = np.array([len(n) for n in numbers], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        places = np.concatenate([np.arange(b, b + n - WINDOW + 1) for b, n in zip(begins, sizes)])
        first = np.repeat(np.array([i for i, _ in passages], dtype=np.int64), sizes - WINDOW + 1)
        hashes = self.window_hashes(self.words, places)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places, self.first = hashes[order], places[order], first[order]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """One number a word; 0 for words that no passage has."""
        known = self.codes.get
        return np.array([known(w, 0) for w in words], dtype=np.int64)

    @staticmethod
    def window_hashes(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return Rolling(mixed(numbers.astype(np.uint64) + np.uint64(1))).of(starts, starts + WINDOW)

    def same(self, numbers: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether windows of ``numbers`` and of the passages have the same words."""
        span = np.arange(WINDOW)

        def compared(which: np.ndarray) -> np.ndarray:
            return np.concatenate([(numbers[starts[w, None] + span] == self.words[places[w, None] + span]).all(axis=1)
                                   for w in np.array_split(which, 1 + len(which) // 20_000)])

        on = np.zeros(len(starts), dtype=bool)   # one word further than the window before, on both sides
        on[1:] = (np.diff(starts) == 1) & (np.diff(places) == 1)
        out = numbers[starts + WINDOW - 1] == self.words[places + WINDOW - 1]
        out[~on] = compared(np.flatnonzero(~on))
        chain = np.cumsum(~on) - 1
        broken = np.flatnonzero((np.bincount(chain, weights=~out) > 0)[chain])
        if len(broken):
            out[broken] = compared(broken)
        return out

    def repeated(self, docs: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
        """Starts of each document's windows that a passage of a smaller id holds."""
        sizes = np.array([len(words) + 1 for _, words in docs])   # an unknown word ends each, so no window spans two
        ends = np.cumsum(sizes)
        numbers = np.concatenate([np.r_[self.numbers(words), 0] for _, words in docs])
        found = np.fromiter((end for end, _ in self.automaton.iter(spelled(numbers))), dtype=np.int64) // DIGITS - (PHRASE - 1)
        near = np.zeros(len(numbers) + WINDOW, dtype=np.int64)   # windows that hold a found phrase whole
        np.add.at(near, np.maximum(found - (WINDOW - PHRASE), 0), 1)
        np.add.at(near, found + 1, -1)
        starts = np.flatnonzero(np.cumsum(near)[:max(len(numbers) - WINDOW + 1, 0)] > 0)
        hashes, own = self.window_hashes(numbers, starts), np.searchsorted(ends, starts, side="right")
        ids = np.array([i for i, _ in docs], dtype=np.int64)[own]
        at, out = np.searchsorted(self.hashes, hashes), np.zeros(len(starts), dtype=bool)
        todo = np.arange(len(starts))
        while len(todo):   # once, but for windows of equal hash
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == hashes[todo]]
            if len(todo):
                same = self.same(numbers, starts[todo], self.places[at[todo]])
                out[todo[same]] = (self.first[at[todo]] < ids[todo])[same]
                todo = todo[~same]
                at[todo] += 1
        cuts = np.searchsorted(own[out], np.arange(1, len(docs)))
        return [s - b for s, b in zip(np.split(starts[out], cuts), ends - sizes)]


def spelled(numbers: np.ndarray) -> str:
    """Each number as ``DIGITS`` characters, each from a range of its own, so that words only match as wholes.

    (The automaton searches a node's children one by one; few characters keep that short.)
    """
    digits = np.stack([(numbers >> 14) + 384, (numbers >> 7 & 127) + 128, (numbers & 127) + 256], axis=1)
    return digits.astype("<u2").tobytes().decode("utf-16-le")


# ---------------------------------------------------------------- steps over all documents

def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def survey(base: DataFrame) -> DataFrame:
    """Every row: id, th, n_words, sha256 of all its words, segments."""

    def run(batches):
        for batch in batches:
            texts, sizes, hashes, shas, segs, done = batch.column("text"), [], [], [], [[] for _ in range(len(batch))], 0

            def flush(end):
                doc, a, b, seed, whole = segments(np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
                                                  np.array(sizes[done:end], dtype=np.int64))
                for d, row in zip(doc.tolist(), zip(a.tolist(), b.tolist(), seed.tolist(), whole.tolist())):
                    segs[done + d].append(row)

            held = 0
            for k in range(len(batch)):
                words = split(texts[k].as_py())
                sizes.append(len(words))
                shas.append(sha256(b" ".join(words)).hexdigest())
                hashes.append(word_hashes(words))
                held += len(words)
                if held >= SLICE_WORDS or k == len(batch) - 1:
                    flush(k + 1)
                    hashes, held, done = [], 0, k + 1
            columns = [pa.array([x for row in segs for x in (s[c] for s in row)], t)
                       for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in segs])], pa.int32())
            nested = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["a", "b", "seed", "whole"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(shas), nested],
                                             ["id", "th", "n_words", "sha", "segs"])

    return staged(per_batch(base, run, "id long, th long, n_words long, sha string, segs array<struct<a:int,b:int,seed:long,whole:long>>"),
                  "phrases-survey")


def recurring_segments(uses: DataFrame) -> DataFrame:
    """Distinct segments of seeds that several documents hold: seg, seed, whole, id, th, a, b (in the first document), last, n (segments of the seed)."""
    distinct = uses.groupBy("seed", "whole").agg(F.min(F.struct("id", "th", "a", "b")).alias("held"), F.max("id").alias("last"))
    seeds = distinct.groupBy("seed").agg(F.count("*").alias("n"), F.min("held.id").alias("first"), F.max("last").alias("latest")).where("first < latest")
    return staged(distinct.join(seeds.select("seed", "n"), "seed").select("seed", "whole", "held.*", "last", "n"),
                  "phrases-segments").withColumn("seg", F.monotonically_increasing_id())


def held_texts(base: DataFrame, keys: DataFrame) -> DataFrame:
    """id, th, text, size of the documents in ``keys``, each once."""
    met = base.where(F.col("id").isNotNull()).join(keys, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    return staged(met.withColumn("size", F.octet_length("text")), "phrases-texts")


def recurring_windows(segs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of seeds with several segments: (seg, seed, h) of all, and (seed, h, id, th, start) of those that recur."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = split(row["text"])
                hashes = word_hashes(words)
                starts = [np.arange(s["a"], s["b"] + 1) for s in row["own"]]
                sizes = [len(s) for s in starts]
                starts = np.concatenate(starts)
                spread = lambda c: np.repeat(np.array([s[c] for s in row["own"]], dtype=np.int64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.full(len(starts), row["id"]), np.full(len(starts), row["th"]), spread("seg"), spread("seed"), spread("last"),
                                           starts.astype(np.int32), window_hashes(hashes, starts))],
                    ["id", "th", "seg", "seed", "last", "start", "h"])

    own = segs.where("n > 1").groupBy("id", "th").agg(F.collect_list(F.struct("seg", "seed", "a", "b", "last")).alias("own"))
    windows = staged(per_batch(own.join(texts, ["id", "th"]).select("id", "th", "own", "text"), run,
                               "id long, th long, seg long, seed long, last long, start int, h long"), "phrases-windows")
    held = windows.groupBy("seed", "h").agg(F.min(F.struct("id", "th", "start")).alias("held"), F.max("last").alias("last"))
    return windows, staged(held.where("held.id < last").select("seed", "h", "held.*"), "phrases-recurring")


def passages(starts: DataFrame, texts: DataFrame) -> DataFrame:
    """id, th, part, size, words: runs of recurring windows (id, th, part, a, b) as texts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = split(row["text"])
                found = [words[a:b + WINDOW] for a, b in merged([(r["a"], r["b"]) for r in row["runs"]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[c]] * len(found), pa.int64()) for c in ("id", "th", "part")]
                    + [pa.array([len(f) for f in found], pa.int64()), pa.array([b" ".join(f).decode() for f in found])],
                    ["id", "th", "part", "size", "words"])

    runs = starts.groupBy("id", "th", "part").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return staged(per_batch(runs.join(texts, ["id", "th"]).select("id", "th", "part", "runs", "text"), run,
                            "id long, th long, part long, size long, words string"), "phrases-passages")


def located(targets: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """id, th, spans (first and last word of what repeats), by shard; ``targets``: id, th, shard."""

    def search(passages: pa.Table, docs: pa.Table) -> pa.Table:
        shard = Shard([(i, w.encode().split()) for i, w in zip(passages.column("id").to_pylist(), passages.column("words").to_pylist())])
        out, batch, held = [], [], 0

        def flush():
            for (i, th, _), starts in zip(batch, shard.repeated([(i, words) for i, _, words in batch])):
                if len(starts):
                    cut = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + WINDOW])
                    last = starts[np.r_[cut[1:], len(starts)] - 1] + WINDOW - 1
                    out.append((i, th, [{"a": a, "b": b} for a, b in zip(starts[cut].tolist(), last.tolist())]))

        for i, th, text in zip(*(docs.column(c) for c in ("id", "th", "text"))):
            batch.append((i.as_py(), th.as_py(), split(text.as_py())))
            held += len(batch[-1][2])
            if held >= SLICE_WORDS:
                flush()
                batch, held = [], 0
        if batch:
            flush()
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["id", "th", "spans"])

    ship_package(texts.sparkSession)
    loads = targets.join(texts.select("id", "th", "size"), ["id", "th"]).groupBy("shard").agg(
        F.ceil(F.sum("size") / TASK_BYTES).cast("int").alias("tasks"))
    loads = broadcast_if_small(staged(loads, "phrases-loads"))
    docs = targets.join(loads, "shard").join(texts, ["id", "th"]).select(
        "shard", F.pmod(F.xxhash64("id", "th"), "tasks").cast("int").alias("task"), "id", "th", "text")
    sides = found.join(loads, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("shard", "task", "id", "words")
    return staged(sides.groupBy("shard", "task").cogroup(docs.groupBy("shard", "task")).applyInArrow(
        search, "id long, th long, spans array<struct<a:int,b:int>>"), "phrases-located")


def repeated_spans(base: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, th, spans of the documents that lose words, and the texts (id, th, text) of all that hold candidates."""
    uses = rows.where(F.col("id").isNotNull()).select("id", "th", F.explode("segs").alias("s")).select("id", "th", "s.*")
    segs = recurring_segments(uses)
    uses = staged(uses.join(segs.select("seed", "whole", "seg"), ["seed", "whole"]).select("id", "th", "seg"), "phrases-uses")
    texts = held_texts(base, uses.select("id", "th").distinct())
    windows, recurring = recurring_windows(segs, texts)

    part = lambda c: F.floor(F.col(c) / SPLIT_WINDOWS)
    alone = segs.where("n = 1").select("seg", "id", "th", "a", "b", part("a").alias("part"))
    more = recurring.select("seed", "h", "id", "th", F.col("start").alias("a"), F.col("start").alias("b"), part("start").alias("part"))
    found = passages(alone.select("id", "th", "part", "a", "b").unionByName(more.select("id", "th", "part", "a", "b")), texts)
    shards = max(1, -(-(found.agg(F.sum("size")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("id", "th", "part"), F.lit(shards)).cast("int").alias("shard")

    routes = alone.select("seg", shard, F.col("id").alias("first")).unionByName(
        windows.select("seg", "seed", "h").join(more.select("seed", "h", shard, F.col("id").alias("first")), ["seed", "h"]).select("seg", "shard", "first"))
    routes = staged(routes.groupBy("seg", "shard").agg(F.min("first").alias("first")), "phrases-routes")
    targets = staged(uses.join(routes, "seg").where("id > first").select("id", "th", "shard").distinct(), "phrases-targets")
    spans = located(targets, found.select(shard, "id", "words"), texts)
    return staged(spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "phrases-spans"), texts


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: id, n_words, n_removed, kept_sha256 (kept words joined by one space), kept (null: the whole text), spans (removed words)."""
    base = _base(docs, id_col, text_col)
    rows = survey(base)
    spans, texts = repeated_spans(base, rows)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = split(row["text"])
                cut = merged([(s["a"], s["b"]) for s in row["spans"]])
                edges = [0, *(x for a, b in cut for x in (a, b + 1)), len(words)]
                kept = b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["id"]], pa.int64()), pa.array([row["th"]], pa.int64()), pa.array([sum(b + 1 - a for a, b in cut)], pa.int64()),
                     pa.array([sha256(kept).hexdigest()]), pa.array([kept.decode()]),
                     pa.array([[{"a": a, "b": b} for a, b in cut]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                    ["id", "th", "n_removed", "kept_sha256", "kept", "spans"])

    cut = per_batch(spans.join(texts, ["id", "th"]).select("id", "th", "spans", "text"), run,
                    "id long, th long, n_removed long, kept_sha256 string, kept string, spans array<struct<a:int,b:int>>")
    return rows.select("id", "th", "n_words", "sha").join(cut, ["id", "th"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept", "spans")
