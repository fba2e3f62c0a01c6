"""Token-id files: Simple-8b words in blocks, written and read by Spark tasks.

Documents are ranged by id; each task tokenizes its range and writes files in that order.
A file holds blocks of ``BLOCK`` ids. A block is a run of 64-bit words: the top four bits
select how many ids the other 60 bits pack, and how wide. An id of more than 60 bits is
an escape: a word with selector ``ESCAPE``, then the id as a raw word. The footer has each
block's first word, so any run of blocks is decoded on its own, selector by selector, in
numpy. It also has each document's id and first position.

    magic | words ... | block offsets | document ids | nulls | document starts | trailer

A file is written beside its place and renamed when it is whole, with a name that depends on
the partition only, so a repeated task replaces its own file by an equal one.

Defined cases: a null text is an empty one; every document ends with the end id, so an
empty document has one id; a null id sorts first; rows with equal ids keep all their
entries, ordered by text; an empty table writes no file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import KEPT, per_batch, shared_path, staged

MAGIC = b"KFS8B001"
BLOCK = 1_024
BATCH_IDS = 1 << 20
ESCAPE = 1
#: (ids in a word, bits of each) by selector; selector 1 is the escape.
SLOTS = ((240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
         (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([c for c, _ in SLOTS], dtype=np.int64)
TRAILER = struct.Struct("<QQQQQ8s")
MANIFEST = "part int, piece int, path string, n_ids long, n_docs long, n_bytes long"


# ---------------------------------------------------------------- Simple-8b

SHORT = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if ids.max(initial=0) < len(SHORT):
        return SHORT[ids]
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint64)
    bits -= (bits > 0) & (ids >> (np.maximum(bits, 1) - np.uint64(1)) == 0)  # rounded up to a power of two
    return bits.astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of ``ids``, packed greedily, all blocks in step."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    nb, wide = -(-n // BLOCK), BLOCK + 240  # the margin pads a block's last word
    m = np.zeros((nb, wide), dtype=np.uint64)
    flat = np.zeros(nb * BLOCK, dtype=np.uint64)
    flat[:n] = ids
    m[:, :BLOCK] = flat.reshape(nb, BLOCK)
    size = np.full(nb, BLOCK, dtype=np.int64)
    size[-1] = n - (nb - 1) * BLOCK

    m = m.ravel()
    bits_of = bit_lengths(m)
    choice = np.full(nb * wide, len(SLOTS) - 1, dtype=np.int8)
    most, reach = bits_of, 1   # most bits of the next ``reach`` ids
    for s in [*range(len(SLOTS) - 2, 1, -1), 0]:  # from one id a word to many
        count, bits = SLOTS[s]
        while reach < count:
            by = min(reach, count - reach)
            most, reach = np.maximum(most, np.r_[most[by:], np.zeros(by, np.uint8)]), reach + by
        choice[most <= bits] = s
    choice[bits_of > 60] = ESCAPE

    rows, starts, slots = [], [], []
    live, pos = np.arange(nb), np.arange(nb) * wide
    end = pos + size
    while len(live):
        s = choice[pos]
        rows.append(live), starts.append(pos), slots.append(s)
        pos = pos + COUNT[s]
        keep = pos < end[live]
        if not keep.all():
            live, pos = live[keep], pos[keep]
    row, start, slot = map(np.concatenate, (rows, starts, slots))
    order = np.argsort(row.astype(np.uint16) if nb < 1 << 16 else row, kind="stable")  # block by block, in the order of the steps
    row, start, slot = row[order], start[order], slot[order]
    width = np.where(slot == ESCAPE, 2, 1)
    where = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), dtype=np.uint64)
    for s in np.unique(slot):
        count, bits = SLOTS[s]
        own = np.flatnonzero(slot == s)
        head = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[where[own]] = head
            words[where[own] + 1] = m[start[own]]
        else:
            w = np.full(len(own), head, dtype=np.uint64)
            if bits:
                for j in range(count):
                    w |= m[start[own] + j] << np.uint64(j * bits)
            words[where[own]] = w
    return words, np.bincount(row, weights=width, minlength=nb).astype(np.int64)


def decode_blocks(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a run of whole blocks; ``block_words``: words of each block."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == ESCAPE).any():  # in a run of escape selectors every other word is an id
        one = sel == ESCAPE
        at = np.arange(len(words))
        began = np.maximum.accumulate(np.where(one & ~np.r_[False, one[:-1]], at, 0))
        escape = one & ((at - began) % 2 == 0)
        raw[1:] = escape[:-1]
    count = COUNT[sel]
    count[raw] = 0
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for s in np.unique(sel[~raw]):
        k, bits = SLOTS[s]
        own = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[base[own]] = words[own + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for j in range(k):
                out[base[own] + j] = (words[own] >> np.uint64(j * bits)) & mask
    first = np.r_[0, np.cumsum(block_words)[:-1]].astype(np.int64)
    slots = np.add.reduceat(count, first) if len(first) else np.empty(0, np.int64)
    size = np.full(len(first), BLOCK, dtype=np.int64)
    if len(size):
        size[-1] = n - (len(size) - 1) * BLOCK
    if (slots == size).all():
        return out
    inside = np.arange(len(out)) - np.repeat(np.cumsum(slots) - slots, slots)
    return out[inside < np.repeat(size, slots)]


# ---------------------------------------------------------------- files

class FileWriter:
    """Streams one token file; nothing but the open block batch and the index is in memory."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.store, self.path = store, path
        folder, name = path.rsplit("/", 1)
        context = TaskContext.get()
        self.temp = f"{folder}/.{name}.{context.taskAttemptId() if context else 0}"
        self.out = store.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.rest, self.held = [], 0
        self.blocks, self.docs, self.nulls, self.starts = [], [], [], []
        self.n_ids = self.n_words = 0

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.starts.append(self.n_ids + np.cumsum(lengths) - lengths)
        self.docs.append(np.array([0 if d is None else d for d in doc_ids], dtype=np.int64))
        self.nulls.append(np.array([d is None for d in doc_ids], dtype=np.uint8))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BATCH_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint64)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BATCH_IDS):
            words, counts = encode_blocks(ids[a:min(end, a + BATCH_IDS)])
            self.out.write(words.astype("<u8").tobytes())
            self.blocks.append(self.n_words + np.cumsum(counts) - counts)
            self.n_words += len(words)
        self.rest, self.held = [ids[end:]], len(ids) - end

    def close(self) -> tuple[str, int, int, int]:
        self._flush(True)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        blocks = np.r_[cat(self.blocks, "<u8"), np.array([self.n_words], "<u8")].astype("<u8")
        docs, nulls = cat(self.docs, "<i8"), cat(self.nulls, "u1")
        starts = np.r_[cat(self.starts, "<u8"), np.array([self.n_ids], "<u8")].astype("<u8")
        place = len(MAGIC) + 8 * self.n_words
        for x in (blocks, docs, nulls, starts):
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(len(blocks) - 1, len(docs), self.n_ids, BLOCK, place, MAGIC))
        size = self.out.tell()
        self.out.close()
        self.store.move(self.temp, self.path)
        return self.path, self.n_ids, len(docs), size


class FileReader:
    """Random access to a token file by its footer."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        head = self.file.read_at(TRAILER.size, size - TRAILER.size)
        nb, nd, self.n_ids, block, place, magic = TRAILER.unpack(head)
        if magic != MAGIC or block != BLOCK:
            raise ValueError(f"not a token file: {path}")
        tail = self.file.read_at(size - TRAILER.size - place, place)
        cut = np.cumsum([8 * (nb + 1), 8 * nd, nd, 8 * (nd + 1)])
        self.blocks = np.frombuffer(tail[:cut[0]], "<u8").astype(np.int64)
        self.docs = np.frombuffer(tail[cut[0]:cut[1]], "<i8")
        self.nulls = np.frombuffer(tail[cut[1]:cut[2]], "u1").astype(bool)
        self.starts = np.frombuffer(tail[cut[2]:cut[3]], "<u8").astype(np.int64)

    def ids(self, first_block: int, last_block: int) -> np.ndarray:
        """Ids of the blocks first_block to last_block - 1."""
        a, b = self.blocks[first_block], self.blocks[last_block]
        words = np.frombuffer(self.file.read_at(8 * (b - a), len(MAGIC) + 8 * a), "<u8")
        n = min(self.n_ids, last_block * BLOCK) - first_block * BLOCK
        return decode_blocks(words, np.diff(self.blocks[first_block:last_block + 1]), int(n))

    def stretches(self, blocks: int = BATCH_IDS // BLOCK) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(self.blocks) - 1, blocks):
            yield a * BLOCK, self.ids(a, min(a + blocks, len(self.blocks) - 1))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, its token ids), in file order."""
        rest, at = np.empty(0, np.uint64), 0
        d = 0
        for start, ids in self.stretches():
            rest = np.concatenate([rest[at - (start - len(rest)):], ids]) if len(rest) else ids
            base = start + len(ids) - len(rest)
            while d < len(self.docs) and self.starts[d + 1] <= start + len(ids):
                yield (None if self.nulls[d] else int(self.docs[d])), rest[self.starts[d] - base:self.starts[d + 1] - base]
                d += 1
            at = int(self.starts[d]) if d < len(self.docs) else start + len(ids)


# ---------------------------------------------------------------- tokenizing

class Tokens:
    """Whole texts to ids with the tokenizers library.

    A byte-level BPE never merges across a single space between two other characters, so
    such a text is the list of its space-separated pieces; the library encodes each distinct
    piece once, in bulk. Texts with other white space around a space, with an added token's
    string, or for another kind of tokenizer, go through the library whole. Splitting, telling
    pieces apart and putting their ids together are done a batch at a time, in Arrow and numpy.
    """

    MOST_PIECES = 1_000_000  # bounds the memory; past it, pieces that came in one batch only are given up

    @classmethod
    def of(cls, path: str) -> Tokens:
        """One tokenizer for each Python worker, kept between its tasks."""
        kept = KEPT.setdefault("tokens", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        white = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
        self.whole = "|".join([f"{white} | {white}", *map(re.escape, added)])
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(self.tok.get_vocab(with_added_tokens=True).values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._forget()

    def _forget(self) -> None:
        """Empty the table of pieces: their ids end to end, and each piece's place in it, by kind (first of a text, later)."""
        self.places: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.ids, self.begin, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.batches = np.empty(0, np.int32)   # in how many each piece came

    def _trim(self) -> None:
        """Keep the pieces that came again; none if they are too many, too."""
        keep = self.batches > 1
        if 2 * keep.sum() > self.MOST_PIECES:
            return self._forget()
        place = (np.cumsum(keep) - 1).tolist()
        kept = keep.tolist()
        self.places = tuple({p: place[i] for p, i in known.items() if kept[i]} for known in self.places)
        sizes = self.size[keep]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.begin[keep] - (ends - sizes), sizes)]
        self.begin, self.size, self.batches = ends - sizes, sizes, np.zeros(len(sizes), np.int32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each with a space before it, end to end; ids of each."""
        lines = [" " + " ".join(new[i:i + 500]) for i in range(0, len(new), 500)]
        ids = np.concatenate(self._plain(lines))
        cut = np.flatnonzero(self.spaced[ids])
        if len(cut) != len(new):
            raise ValueError("this tokenizer doesn't keep pieces apart")
        return ids, np.diff(cut, append=len(ids))

    def _add(self, known: dict[str, int], new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(sizes) - sizes]
        self.size, self.ids = np.r_[self.size, sizes], np.r_[self.ids, ids]
        self.batches = np.r_[self.batches, np.zeros(len(new), np.int32)]

    def _places(self, pieces: list[str], later: bool) -> np.ndarray:
        """Each distinct piece's place in the table; pieces that aren't there are encoded and added."""
        known = self.places[later]
        if later and "" not in known:   # between two spaces, or after the last
            self._add(known, [""], space := self._plain([" "])[0], np.array([len(space)]))
        get = known.get
        out = np.array([get(p, -1) for p in pieces], dtype=np.int64)
        new = [pieces[i] for i in np.flatnonzero(out < 0).tolist()]
        if new:
            start = len(self.size)
            if later:
                self._add(known, new, *self._spaced(new))
            else:
                coded = self._plain(new)
                self._add(known, new, np.concatenate(coded), np.array([len(c) for c in coded], dtype=np.int64))
            out[out < 0] = np.arange(start, len(self.size))
        self.batches[out] += 1
        return out

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets, values = lists.offsets.to_numpy(), lists.flatten()
        offsets = offsets - offsets[0]
        if len(self.size) > self.MOST_PIECES:
            self._trim()
        first = np.zeros(len(values), dtype=bool)
        first[offsets[:-1]] = True
        place = np.empty(len(values), dtype=np.int64)
        for later in (False, True):
            coded = values.filter(pa.array(first != later)).dictionary_encode()
            place[first != later] = self._places(coded.dictionary.to_pylist(), later)[coded.indices.to_numpy()]
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(ends[-1], dtype=np.int32) + np.repeat((self.begin[place] - (ends - sizes)).astype(np.int32), sizes)]
        return flat, np.add.reduceat(sizes, offsets[:-1])

    def encode_flat(self, texts: pa.Array, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ``tail`` after each, and each text's number of ids, tail included."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(n, dtype=bool)
        whole = self._plain(texts.filter(pa.array(odd)).to_pylist())
        sizes = np.zeros(n, dtype=np.int64)
        sizes[odd] = [len(x) for x in whole]
        flat = np.empty(0, "<u4")
        if not odd.all():
            flat, sizes[~odd] = self._by_pieces(texts.filter(pa.array(~odd)))
        out = np.empty(int(sizes.sum()) + n * len(tail), dtype="<u4")
        if not odd.any() and len(tail) == 1:
            ids, ends = np.ones(len(out), dtype=bool), np.cumsum(sizes + 1) - 1
            ids[ends] = False
            out[ids], out[ends] = flat, tail[0]
            return out, sizes + 1
        kind = np.repeat(np.c_[odd, np.full((n, len(tail)), 2)].ravel(), np.c_[sizes, np.ones((n, len(tail)), np.int64)].ravel())
        out[kind == 0], out[kind == 1], out[kind == 2] = flat, np.concatenate([*whole, np.empty(0, "<u4")]), tail * n
        return out, sizes + len(tail)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        flat, sizes = self.encode_flat(pa.array(texts, pa.string()), [])
        return [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 27) -> DataFrame:
    """Write ``docs`` as token files in ascending id order; returns the manifest (one row per file)."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("spread", F.monotonically_increasing_id())  # parts rows that are equal
            .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("spread")))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "spread").select("doc_id", "text")

    def write(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, piece, out, done = TaskContext.get().partitionId(), 0, None, []
        tok = Tokens.of(tokenizer)

        def closed():
            path, n_ids, n_docs, size = out.close()
            done.append((part, piece, path, n_ids, n_docs, size))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in _slices(texts):
                b = a.stop
                if out is None:
                    out = FileWriter(store, f"{base}/part-{part:06d}-{piece:04d}.s8b")
                flat, sizes = tok.encode_flat(texts[a], [end_id])
                out.add(ids[a.start:b], sizes, flat.astype(np.uint64))
                if out.n_ids >= file_ids:
                    closed()
                    out, piece = None, piece + 1
        if out is not None:
            closed()
        cols = list(zip(*done)) or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         ["part", "piece", "path", "n_ids", "n_docs", "n_bytes"])

    return staged(per_batch(rows, write, MANIFEST, keep="tokens"), "token-manifest").withColumn("folder", F.lit(folder))


def _slices(texts: pa.Array, chars: int = 4 << 20) -> Iterator[slice]:
    """Row ranges of about ``chars`` characters, so that a batch of long texts isn't held at once."""
    sizes = np.array(pc.utf8_length(texts).to_pylist(), dtype=np.int64)
    a, total = 0, 0
    for i, s in enumerate(sizes):
        total += s
        if total >= chars or i == len(sizes) - 1:
            yield slice(a, i + 1)
            a, total = i + 1, 0


def read_token_files(manifest: DataFrame, tokens: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and its token ids), read from the files.

    One task reads a file at a time, a megabyte of ids at once; ``start`` counts the ids of
    the files before it.
    """
    order = Window.orderBy("part", "piece")  # one row per file
    files = staged(manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids")), "token-order")
    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if tokens else "")

    def read(batches):
        for batch in batches:
            for path, folder, before in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "before"))):
                store, _ = pafs.FileSystem.from_uri(folder)
                f = FileReader(store, path)
                if tokens:
                    yield from _whole(f, before)
                else:
                    yield from _digests(f, before)

    return per_batch(files.repartitionByRange(n, "part", "piece"), read, schema)


def _whole(f: FileReader, before: int):
    for (doc, ids), start in zip(f.documents(), f.starts):
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc], pa.int64()), pa.array([before + int(start)], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.array([crc], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))],
            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _digests(f: FileReader, before: int):
    crcs = np.zeros(len(f.docs), dtype=np.int64)
    starts, d = f.starts.tolist(), 0
    for first, ids in f.stretches():
        data, end = memoryview(ids.astype("<u4").tobytes()), first + len(ids)
        while d < len(crcs) and starts[d] < end:
            a, b = max(starts[d], first), min(starts[d + 1], end)
            crcs[d] = zlib.crc32(data[4 * (a - first):4 * (b - first)], int(crcs[d]))
            if starts[d + 1] > end:
                break
            d += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ma.array(f.docs, mask=f.nulls), pa.int64()) if f.nulls.any() else pa.array(f.docs, pa.int64()),
         pa.array(before + f.starts[:-1], pa.int64()), pa.array(np.diff(f.starts), pa.int64()), pa.array(crcs, pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` as token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, tokenizer, **options))
