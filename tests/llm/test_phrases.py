import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from kpiforge.llm import phrases
from tests.llm.helpers import docs_frame, odd_documents, sentence

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows):
    """Sorted (id, words, removed, digest) of (id, text) rows, window by window."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s:s + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s:s + 50])] < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(docs).collect()), key=str)


def planted(seed, n=60):
    """Passages of 40 to 200 words, whole, in part, edited, at edges, in rows and inside out."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    pool = [[word() for _ in range(rng.choice([40, 49, 50, 51, 74, 75, 76, 100, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [word() for _ in range(rng.randrange(0, 40))]
            p = list(rng.choice(pool))
            kind = rng.randrange(5)
            if kind == 1:
                cut = rng.randrange(len(p))
                p = p[cut:] if rng.random() < 0.5 else p[:cut]
            if kind == 2:
                p[rng.randrange(len(p))] = word()
            if kind == 3:
                p = p + p[:rng.randrange(len(p))]
            words += p
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rng.shuffle(rows)
    return rows


def test_planted_passages_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = planted(seed)
        want = brute(rows)
        assert any(r[2] for r in want) and found(docs_frame(spark, rows)) == want


def test_one_passage_and_copies_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 500)       # several shards
    monkeypatch.setattr(phrases, "TASK_BYTES", 20_000)     # several tasks a shard
    monkeypatch.setattr(phrases, "SPLIT_WINDOWS", 40)
    rows = [(k, sentence(20, 100 * k, "a") + " " + sentence(120, 0, "common") + " " + sentence(k % 90, 100 * (k // 7), "b")) for k in range(150)]
    rows += [(1_000 + k, sentence(300, 0, "copy") + (f" end{k}" if k % 3 else "")) for k in range(90)]
    assert found(docs_frame(spark, rows)) == brute(rows)


def test_runs_of_one_word(spark):
    rows = [(1, "x " * 120), (2, "x " * 49), (3, "x " * 50 + "y"), (4, "y " + "x " * 130), (5, "x y " * 80), (6, "y x " * 40)]
    assert found(docs_frame(spark, rows)) == brute(rows)


def test_odd_documents(spark):
    rows = odd_documents() + [(8, sentence(29_000, 500)), (None, sentence(100)), (None, sentence(100)), (9, "a\x1cb c d " * 60),
                              (10, "a\x1cb c d " * 60), (-3, sentence(70, 40)), (4, "same row")]
    docs = docs_frame(spark, rows)
    for extra in ("id", "th", "segs", "seed", "a", "b", "shard", "size"):
        docs = docs.withColumn(extra, F.lit("clash"))
    assert found(docs) == brute(rows)


def test_no_documents(spark):
    assert found(docs_frame(spark, [(1, "a")]).limit(0)) == []


def test_spans_and_kept_text(spark):
    rows = [(1, sentence(60)), (2, "one two " + sentence(60) + " three")]
    got = {r.id: r for r in phrases.without_repeats(docs_frame(spark, rows)).collect()}
    assert got[1].kept is None and got[2].kept == "one two three" and [tuple(s) for s in got[2].spans] == [(2, 61)]
