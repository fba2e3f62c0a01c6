"""WARC archives: written by tasks, read in byte ranges with boundary-chain verification.

Writing: each page is a record. Of equal payloads, the page with the largest id is a
``response``; the others are ``revisit`` records that refer to it and carry no payload.

Reading: an archive is cut into byte ranges, one task each. A task can't know which
``WARC/1.`` in its range starts a record and which lies inside a payload, so it emits every
candidate's offset with its successor's (from the candidate's own header), shortened to the
first successor outside the range. Pointer jumping over these few range-to-range links,
from each file's start, keeps the offsets that a chain of records reaches; each range then
reads on from its verified entry only. Magic inside payloads is on no such chain. A header may
have any length: where a buffer holds no blank line, more is read, to the file's end if need be.
``complete`` holds the records read against the manifest's counts.

Defined cases: a null html is an empty payload (also written as a record); a null url writes
no target; a null id sorts below all others; rows with equal ids and payloads are all
responses if that id is the largest; an archive that breaks off keeps the records before the
break; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, per_batch, shared_path, staged

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)
BLANK = b"\r\n\r\n"
#: First read beyond a byte range for the header of its last candidate.
HEAD_BYTES = 1 << 16
CHUNK_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
URN = "urn:kpiforge:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, folder string, bytes long, records long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, path string, offset long, digest_ok boolean")


# ---------------------------------------------------------------- writing

def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One record; a revisit's block has the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <{URN}{name}>\r\nWARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{URN}{refers_to}>")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: the largest id among equal payloads of ``least_bytes`` or more.

    Only payloads that occur more than once are joined back.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = F.sha1(F.encode("html", "UTF-8"))
    again = (d.where(F.octet_length("html") >= least_bytes).groupBy(key.alias("payload"))
             .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = broadcast_if_small(staged(again, "warc-equal"))
    return d.join(again, key == F.col("payload"), "left").drop("payload")


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   date: str = "2020-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write ``pages`` as archives; returns the manifest (one row per archive)."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def write(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        out, size, n, done = None, 0, 0, []

        def closed():
            out.close()
            store.move(temp, path)
            done.append((path, size, n))

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, original = (batch.column(k)[i].as_py() for k in range(4))
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if out is None:
                    name = f"part-{context.partitionId():06d}-{len(done):04d}.warc"
                    path, temp = f"{base}/{name}", f"{base}/.{name}.{context.taskAttemptId()}"
                    out, size, n = store.open_output_stream(temp), 0, 0
                revisit = original is not None and page_id != original
                data = record(page_id, url, payload, digest, original, revisit, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    closed()
                    out = None
        if out is not None:
            closed()
        paths, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([folder] * len(done), pa.string()),
                                          pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                         ["path", "folder", "bytes", "records"])

    rows = with_originals(pages, least_bytes, **columns).select("page_id", "url", "html", "refers_to")
    return staged(per_batch(rows, write, MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading

def parse_head(data, at: int) -> tuple[int, int] | None:
    """(block's start, successor's offset) relative to ``data``, or None where no header starts."""
    end = data.find(BLANK, at)
    found = LENGTH.search(data, at, end + 2) if end >= 0 else None
    if not found:
        return None
    return end + 4, end + 4 + int(found[1]) + 4


def candidate_heads(data, at: list[int]) -> list[tuple[int, int]]:
    """(offset, successor's offset) relative to ``data`` of the candidates ``at`` with a header.

    As ``parse_head`` on each, but in one pass: candidates before the same blank line don't each search up to it.
    """
    lengths = list(LENGTH.finditer(data))
    t, end, following, out = len(lengths), -1, len(data), []
    for x in reversed(at):
        own = data.find(BLANK, x, min(following + 3, len(data)))
        end, following = own if own >= 0 else end, x
        while t and lengths[t - 1].start() >= x:
            t -= 1
        if end >= 0 and t < len(lengths) and lengths[t].end() <= end + 2:
            out.append((x, end + 4 + int(lengths[t][1]) + 4))
    return out[::-1]


def chunk_links(file, start: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, exit) of the candidates in a byte range; exit: the chain's first offset not before ``end``.

    A candidate whose chain breaks inside the range has no exit and is left out.
    """
    data = file.read_at(min(end + HEAD_BYTES, size) - start, start)
    found = [m.start() for m in MAGIC.finditer(data, 0, min(len(data), end - start + 9)) if m.start() < end - start]
    while found and data.find(BLANK, found[-1]) < 0 and start + len(data) < size:
        data += file.read_at(min(max(len(data), HEAD_BYTES), size - start - len(data)), start + len(data))
    heads = [(start + x, start + y) for x, y in candidate_heads(data, found) if start + y <= size]
    at, to = np.array(heads, dtype=np.int64).reshape(-1, 2).T.copy()
    if not len(at):
        return at, to
    place = np.minimum(np.searchsorted(at, to), len(at) - 1)
    inside = (to < end) & (at[place] == to)
    jump = np.where(inside, place, np.arange(len(at)))  # the chain's last candidate points to itself
    while not np.array_equal(nxt := jump[jump], jump):
        jump = nxt
    out = to[jump]
    return at[out >= end], out[out >= end]


def _ranges(manifest: DataFrame, chunk_bytes: int) -> DataFrame:
    d = manifest.select("path", "folder", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / chunk_bytes))).alias("chunk"))
    return staged(d, "warc-ranges")


def _spread(ranges: DataFrame) -> DataFrame:
    """One byte range per task, as far as there are partitions."""
    return ranges.repartitionByRange(max(1, min(ranges.count(), 20_000)), "path", "chunk")


def chunk_entries(ranges: DataFrame, chunk_bytes: int) -> DataFrame:
    """(path, entry): the offset at which a verified chain of records enters each byte range."""

    def scan(batches):
        for batch in batches:
            for path, folder, size, chunk in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "bytes", "chunk"))):
                store, _ = pafs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    at, out = chunk_links(f, chunk * chunk_bytes, min((chunk + 1) * chunk_bytes, size), size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at), pa.array(out)],
                                                 ["path", "at", "exit"])

    links = staged(per_batch(_spread(ranges), scan, "path string, at long, exit long"), "warc-links")
    starts = ranges.select("path", F.lit(0).cast("long").alias("at")).distinct()
    # only candidates at which some chain leaves a range can be entries
    doors = links.select("path", F.col("exit").alias("at")).distinct().union(starts).distinct()
    jump = staged(links.join(doors, ["path", "at"], "left_semi"), "warc-jumps")
    reached = staged(starts, "warc-reached")
    rounds = int(ranges.agg(F.max("chunk")).first()[0] or 0).bit_length()
    for _ in range(rounds):  # after k rounds: entries up to 2^k - 1 ranges from the file's start
        step = jump.select("path", "at", F.col("exit").alias("to"))
        reached = staged(reached.union(reached.join(step, ["path", "at"]).select("path", F.col("to").alias("at"))).distinct(),
                         "warc-reached")
        far = jump.select("path", F.col("at").alias("to"), F.col("exit").alias("far"))
        jump = staged(step.join(far, ["path", "to"]).select("path", "at", F.col("far").alias("exit")), "warc-jumps")
    return reached.select("path", F.col("at").alias("entry"))


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payloads: bool = False) -> DataFrame:
    """The verified records of the archives (``payloads``: with the payload as binary column)."""
    ranges = _ranges(manifest, chunk_bytes)
    entries = chunk_entries(ranges, chunk_bytes).withColumn("chunk", F.floor(F.col("entry") / chunk_bytes))
    work = staged(ranges.join(entries, ["path", "chunk"]), "warc-work")
    schema = RECORD + (", payload binary" if payloads else "")

    def read(batches):
        for batch in batches:
            for path, folder, size, chunk, entry in zip(*(batch.column(c).to_pylist() for c in (
                    "path", "folder", "bytes", "chunk", "entry"))):
                store, _ = pafs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as f:
                    rows = []
                    for row in records_from(f, path, entry, min((chunk + 1) * chunk_bytes, size), size, payloads):
                        rows.append(row)
                        if len(rows) >= (64 if payloads else 4096):
                            yield _batch(rows, payloads)
                            rows = []
                    yield _batch(rows, payloads)

    return per_batch(_spread(work), read, schema)


def complete(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` (staged), or an error where an archive gave another number of records than the manifest says."""
    read = records.groupBy("path").agg(F.count("*").alias("found"))
    wrong = (manifest.join(read, "path", "left").select("path", "records", F.coalesce("found", F.lit(0)).alias("found"))
             .where("records != found").limit(5).collect())
    if wrong:
        raise ValueError("records missing or extra: " + "; ".join(f"{r.path}: {r.found} of {r.records}" for r in wrong))
    return records


def _batch(rows: list, payloads: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(),
             pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
    k = len(types) if payloads else len(types) - 1
    cols = list(zip(*rows)) if rows else [[]] * k
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types[:k])], names[:k])


def records_from(file, path: str, entry: int, end: int, size: int, payloads: bool = False) -> Iterator[tuple]:
    """Records that start in [entry, end), read one after the other from a verified entry."""
    base, data, offset = entry, b"", entry
    while offset < end:
        while base + len(data) < size and data.find(BLANK, offset - base) < 0 and (
                base + len(data) < offset + 10 or MAGIC.match(data, offset - base)):
            base, data = offset, file.read_at(min(max(4 << 20, 2 * (base + len(data) - offset)), size - offset), offset)
        head = parse_head(data, offset - base) if MAGIC.match(data, offset - base) else None
        if head is None or base + head[1] > size:
            return
        if head[1] > len(data):
            base, data = offset, file.read_at(base + head[1] - offset, offset)
            head = parse_head(data, 0)
        fields = {}
        for line in data[offset - base:head[0]].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        block = data[head[0]:head[1] - 4]
        cut = block.find(b"\r\n\r\n") + 4
        length, payload = LENGTH.search(block, 0, cut), block[cut:]
        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        whole = kind != "revisit"
        ok = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if whole else None
        row = (_page(fields.get("warc-record-id")), int(length[1]) if length else len(payload), digest, kind,
               _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), path, offset, ok)
        yield (*row, payload) if payloads else row
        offset = base + head[1]


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(name) if re.fullmatch(r"-?\d+", name) else None
