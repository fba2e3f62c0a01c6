"""Secret scan: known formats, and a randomness test battery for strings of unknown format.

Known formats (assignments, access keys, long hexadecimal runs) are found by pattern. Besides,
every maximal run of ``LEAST`` or more base-64 characters is a candidate, letters alone too. Known
spans are cut out of it, and each part that is left is one. A candidate's encoding is inferred (the
smallest alphabet that holds its characters), and three tests ask whether its symbols look drawn at
random from that alphabet: chi-squared uniformity, runs about the alphabet's middle, and lag-one
serial correlation; Fisher's method joins their p-values. The values of known spans (``LEAST``
characters or more) are tested in the same way.

Two nulls guard the report, each controlled inside bands of length (Benjamini-Hochberg over all
candidates of the corpus in a band). Rejecting "random" means ordinary text: a short string seldom
rejects, a long one does by itself, so few real keys are dismissed. Rejecting "ordinary" asks how
odd a candidate is as ordinary text: the symbol pairs outside all runs, counted over all documents,
give a Markov model, and the likelihood of a uniform draw over the model's is an e-value (its
inverse bounds a p-value), so few ordinary strings are reported. A candidate that isn't rejected as
random and is rejected as ordinary has kind ``random``; known spans stay whatever the tests say of
their values, ``confirmed`` counts the values that pass both.

Defined cases: null or empty texts have no spans; positions are code points, end exclusive;
a text of any length is searched whole, in time linear in its length; repeated rows each count
and are all returned; an empty table gives no rows. Only the id and text columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import per_batch, staged

#: Known formats: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

LEAST = 20
SEPARATORS = "+/_=-"
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Encodings, smallest alphabet first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex-upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36-upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
INDEX = [(name, {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
#: Lower bounds of the length bands.
BANDS = (20, 24, 32, 48, 64, 96, 128, 256)
#: Symbols of the ordinary model (all others are one more), and the weight of single symbols against pairs
#: (``MIX`` holds however often texts repeat, so that copies don't make a rare pair look impossible).
SYMBOLS = ALPHABETS[-1][1]
STATES = len(SYMBOLS) + 1
CLASS = np.full(256, STATES - 1, dtype=np.uint8)
CLASS[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = np.arange(STATES - 1)
PRIOR, MIX = 30.0, 0.1
CHUNK = 1 << 22
GRID = 40  # steps of p in a decade; p is rounded up to the grid
LEAST_P = 25 * GRID


def base_spans(text: str) -> tuple[list, list, list]:
    """(known spans as (start, kind's place, end), their values as (start, end), runs as (start, end)).

    Access keys and long hexadecimal runs lie inside runs, so only those are searched.
    """
    spans, values, runs = [], [], []
    if ":" in text or "=" in text:
        found = [m for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        spans += [(m.start(), 0, m.end()) for m in found]
        values += [m.span(2) for m in found]
    for r in RUN.finditer(text):
        a, run = r.start(), r[0]
        runs.append(r.span())
        known = [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= LEAST_ACCESS]
        known += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(run) if len(m[0]) >= LEAST_HEX]
        spans += known
        values += [(x, y) for x, _, y in known]
    return sorted(spans), sorted(values), runs


def uncovered(text: str, runs: list, spans: list) -> list:
    """The parts of ``runs`` outside ``spans`` (sorted by start), without separators at a cut; ``LEAST`` characters or more."""
    cover: list[list[int]] = []
    for x, _, y in spans:
        if cover and x <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], y)
        else:
            cover.append([x, y])
    ends, out = [y for _, y in cover], []
    for a, b in runs:
        at, k, cut = a, bisect_right(ends, a), []
        while k < len(cover) and cover[k][0] < b:
            cut.append((at, cover[k][0]))
            at, k = cover[k][1], k + 1
        cut.append((at, b))
        for x, y in cut:
            while a < x < y and text[x] in SEPARATORS:
                x += 1
            while x < y < b and text[y - 1] in SEPARATORS:
                y -= 1
            if y - x >= LEAST:
                out.append((x, y))
    return out


def randomness(run: str) -> tuple[str, float]:
    """(inferred encoding, p-value of "drawn at random from its alphabet"); padding and dots are left out."""
    body = run.replace("=", "").replace(".", "")
    if len(body) < 2:
        return "none", 0.0
    chars = set(body)
    name, index = next(((n, i) for n, i in INDEX if chars <= i.keys()))
    x = np.array([index[c] for c in body], dtype=np.float64)
    n, k = len(x), len(index)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    h = 2 / (9 * (k - 1))  # Wilson-Hilferty
    p_uniform = _upper(((chi / (k - 1)) ** (1 / 3) - (1 - h)) / math.sqrt(h))
    high = x >= k / 2
    n1, n0 = int(high.sum()), int(n - high.sum())
    if n1 and n0:
        mean, var = 1 + 2 * n1 * n0 / n, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
        p_runs = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    total = float(d @ d)
    r1 = float(d[1:] @ d[:-1]) / total if total else 1.0
    p_serial = 2 * _upper(abs(r1 + 1 / n) * math.sqrt(n))
    f = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, min(1, p_runs), min(1, p_serial)))
    y = f / 2
    return name, min(1.0, math.exp(-y) * (1 + y + y * y / 2)) if y < 700 else 0.0


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def grid_p(p: float) -> int:
    """The grid place of p, rounded so that the grid's p isn't below it."""
    return min(LEAST_P, math.floor(-math.log10(p) * GRID)) if p > 0 else LEAST_P


def pair_counts(data: bytes) -> np.ndarray:
    """How often each symbol follows each, as ``STATES`` squared counts."""
    out = np.zeros(STATES * STATES, dtype=np.int64)
    for at in range(0, len(data) - 1, CHUNK):
        c = CLASS[np.frombuffer(data[at:at + CHUNK + 1], dtype=np.uint8)].astype(np.int16)
        out += np.bincount(c[:-1] * np.int16(STATES) + c[1:], minlength=len(out))
    return out


def ordinary_model(counts: np.ndarray) -> np.ndarray:
    """log P(next symbol | symbol): pairs smoothed by single symbols."""
    c = counts.reshape(STATES, STATES).astype(np.float64)
    single = (c.sum(axis=0) + 1) / (c.sum() + STATES)
    pairs = (c + PRIOR * single) / (c.sum(axis=1, keepdims=True) + PRIOR)
    return np.log((1 - MIX) * pairs + MIX * single)


def oddness(run: str, encoding: str, model: np.ndarray) -> int:
    """Grid place of the p-value of "ordinary": 1 / e for the e-value of a uniform draw from one of the alphabets."""
    if encoding == "none":
        return 0
    x = CLASS[np.frombuffer(run.replace("=", "").replace(".", "").encode(), dtype=np.uint8)]
    size = next(len(i) for n, i in INDEX if n == encoding)
    ordinary = float(model[STATES - 1, x[0]] + model[x[:-1], x[1:]].sum())
    e = -len(x) * math.log(size) - math.log(len(INDEX)) - ordinary
    return max(0, min(LEAST_P, math.floor(e / math.log(10) * GRID)))


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


SCANNED = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
           "base array<struct<start:int,kind:int,end:int>>, "
           "runs array<struct<start:int,end:int,band:int,grid:int,odd:int,encoding:string,known:boolean>>")


def ordinary_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``pair_counts`` of the text outside all runs, over all documents (at most ``STATES`` squared rows come back)."""
    def run(batches):
        total = np.zeros(STATES * STATES, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):
                rest = RUN.sub("\n", text.as_py() or "")
                held.append(rest)
                size += len(rest)
                if size >= CHUNK:
                    total += pair_counts("\n".join(held).encode())
                    held, size = [], 0
            total += pair_counts("\n".join(held).encode())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    counts = np.zeros(STATES * STATES, dtype=np.int64)
    for r in per_batch(docs.select(F.col(f"`{text_col}`")), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return counts


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known spans and tested candidates of every text, one row per row of ``docs``; ``model``: ``ordinary_model``."""
    span_t = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    run_t = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("grid", pa.int32()), ("odd", pa.int32()),
                       ("encoding", pa.string()), ("known", pa.bool_())])

    def one(text):
        spans, values, runs = base_spans(text) if text else ([], [], [])
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        tested = []
        for a, b, known in [(a, b, True) for a, b in values if b - a >= LEAST] + [(a, b, False) for a, b in uncovered(text, runs, spans)]:
            name, p = randomness(text[a:b])
            tested.append({"start": a, "end": b, "band": band(b - a), "grid": grid_p(p),
                           "odd": oddness(text[a:b], name, model), "encoding": name, "known": known})
        return (*n, digest, [{"start": a, "kind": k, "end": b} for a, k, b in spans], tested)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            rows = [one(t.as_py()) for t in texts]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span_t), pa.list_(run_t))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCANNED)


def rejection_limits(scanned: DataFrame, q: float, field: str = "grid") -> list[int]:
    """Per band the grid place from which ``field``'s null is rejected (Benjamini-Hochberg at ``q``)."""
    counts = (scanned.select(F.explode("runs").alias("r")).groupBy("r.band", F.col(f"r.{field}").alias("grid"))
              .agg(F.count("*").alias("n")))
    by_band = Window.partitionBy("band")  # at most LEAST_P + 1 rows a band
    smallest_first = by_band.orderBy(F.desc("grid"))
    hit = F.pow(F.lit(10.0), -F.col("grid") / GRID) <= F.lit(q) * F.sum("n").over(smallest_first) / F.sum("n").over(by_band)
    rows = counts.withColumn("hit", hit).where("hit").groupBy("band").agg(F.min("grid").alias("limit")).collect()
    found = {r["band"]: r["limit"] for r in rows}
    return [found.get(b, LEAST_P + 1) for b in range(len(BANDS))]


def find_secrets(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts and digest of the known spans, all spans (``found`` as structs, ``spans`` as text), ``confirmed``."""
    model = ordinary_model(ordinary_pairs(docs, text_col))
    scanned = staged(scan(docs, model, id_col, text_col), "secret-scan")
    ordinary, odd = (F.array(*(F.lit(x) for x in rejection_limits(scanned, q, f))) for f in ("grid", "odd"))
    passes = F.filter("runs", lambda r: (r["grid"] < F.get(ordinary, r["band"])) & (r["odd"] >= F.get(odd, r["band"])))
    random = F.filter(passes, lambda r: ~r["known"])
    confirmed = F.size(F.filter(passes, lambda r: r["known"])).cast("long")
    found = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform(random, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"),
                                               r["end"].alias("end")))))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return (scanned.withColumn("found", found)
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found", confirmed.alias("confirmed")))
