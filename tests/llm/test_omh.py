import random

import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import omh
from kpiforge.llm.common import words
from kpiforge.llm.tiling import WordHashes
from tests.llm.helpers import docs_frame, odd_documents, sentence


def base(k, n=200):
    rng = random.Random(k)
    return [f"v{rng.randrange(400)}" for _ in range(n)]


def edited(w, edits, seed):
    w, rng = list(w), random.Random(seed)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"e{rng.randrange(10 ** 6)}"
    return w


def brute_classes(rows):
    """Smallest id of each connected component over all pairs."""
    cache, kmers = WordHashes(), {i: omh.labelled_kmers(words(t), WordHashes()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, t in rows:
        for j, u in rows:
            if j < i and (t == u or omh.similarity(kmers[i], kmers[j]) >= omh.SIMILARITY):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(spark):
    rows, i = [], 0
    for k in range(12):
        w = base(k)
        for c in range(6):
            rows.append((i, " ".join(edited(w, [0, 0, 1, 2, 4, 12][c], i))))
            i += 1
    rows += [(1000 + k, " ".join(base(100 + k, 60) + base(999, 60))) for k in range(15)]   # one long passage in all
    got = {r.id: r.class_id for r in omh.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_chain_through_a_middle_text(spark):
    texts = [base(1)]
    for k in range(1, 5):   # neighbours are similar, the ends are not
        texts.append(edited(texts[-1], 3, k))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute_classes(rows)
    assert len(set(want.values())) == 1
    ends = [omh.labelled_kmers(texts[k], WordHashes()) for k in (0, 4)]
    assert omh.similarity(*ends) < omh.SIMILARITY
    got = {r.id: r.class_id for r in omh.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == want


def test_alignment_is_order_sensitive():
    w = [f"u{k}" for k in range(100)]
    c = WordHashes()
    a, b = omh.labelled_kmers(w, c), omh.labelled_kmers(w[50:] + w[:50], c)
    assert len(set(a.tolist()) & set(b.tolist())) == 92 and omh.similarity(a, b) < 0.8
    assert omh.similarity(a, a) == 1
    one = omh.labelled_kmers(w[:30] + ["new"] + w[30:], c)
    assert np.isclose(omh.similarity(a, one), 92 / (96 + 97 - 92))


def test_repeated_words_count_by_occurrence():
    c = WordHashes()
    a, b = omh.labelled_kmers(["a"] * 100, c), omh.labelled_kmers(["a"] * 50, c)
    assert len(set(a.tolist())) == 96 and omh.similarity(a, b) == 0


def test_large_group_of_near_copies_stays_linear(spark):
    w = base(3, 120)
    rows = [(k, " ".join(edited(w, 1, k))) for k in range(400)]
    out = omh.near_duplicates(docs_frame(spark, rows))
    assert {r.class_id for r in out.collect()} == {0}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(200, 300), (300, 250), (7, 7)]
    d = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in pairs], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in omh.components(d).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 250: 200, 300: 200}


def test_one_row_of_each_class_stays(spark):
    w = base(5)
    rows = [(500, " ".join(w)), (300, " ".join(edited(w, 1, 1))), (900, " ".join(w)), (20, sentence(40)), (20, sentence(40)), *odd_documents()]
    d = docs_frame(spark, rows).withColumns({"node": F.lit("n"), "root": F.lit(1)})
    kept = omh.one_per_class(d)
    assert kept.columns == d.columns
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect())
    assert [g for g in got if g[0] in ("300", "500", "900")] == [("300", rows[1][1][:20])]
    assert sum(g[0] == "20" for g in got) == 1 and sum(g == ("4", "same row") for g in got) == 1
    assert sum(g[0] in ("1", "2") for g in got) == 1   # null and empty texts are equal
    assert omh.one_per_class(docs_frame(spark, [])).count() == 0


def test_dense_family_near_the_threshold_equals_all_pairs(spark):
    """Independent edits around one template: few texts are similar to any one hub, most to some other."""
    w = base(11)
    rows = [(k, " ".join(edited(w, 2 + k % 3, k))) for k in range(300)]
    want = brute_classes(rows)
    got = {r.id: r.class_id for r in omh.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == want


def test_blocks_of_a_mixed_bucket_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(omh, "BLOCK", 7)
    monkeypatch.setattr(omh, "WORTHWHILE", 2)   # the exact finish has most of the work
    w = base(11)
    rows = [(k, " ".join(edited(w, 2 + k % 3, k))) for k in range(120)]
    got = {r.id: r.class_id for r in omh.near_duplicates(docs_frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_columns_of_any_name_stay(spark):
    d = docs_frame(spark, [(1, sentence(40)), (1, sentence(40)), (2, sentence(40)), (3, sentence(40, 100))])
    d = d.withColumns({"_j_id": F.lit(1), "_J_node": F.lit("k"), "node": F.lit(3)})
    kept = omh.one_per_class(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
