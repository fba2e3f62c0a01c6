import random

import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import tiling
from kpiforge.llm.common import words
from tests.llm.helpers import docs_frame, odd_documents, sentence


def brute_tiles(doc, item, least=5):
    """Greedy string tiling by comparing every pair of places."""
    a, b = words(doc), words(item)
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        fa[i:i + n], fb[j:j + n] = [False] * n, [False] * n
        out += n


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_coverage_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}x{j % 31}" for j in range(40))) for k in range(4)]
    docs = []
    for d in range(25):
        w = items[d % 4][1].split()
        cut = rng.sample(range(40), 3)
        parts = [w[c:c + rng.randint(3, 14)] for c in cut]
        rng.shuffle(parts)
        docs.append((d, " filler ".join(" ".join(p) for p in parts) + " " + sentence(30, d * 100)))
    got = {(r.id, r.item_id): r.covered for r in tiling.coverage(docs_frame(spark, docs), items_frame(spark, items)).collect()}
    for i, t in docs:
        for k, u in items:
            assert got.get((i, k), 0) == brute_tiles(t, u), (i, k)


def test_reordered_passages_are_caught_and_clean_documents_stay(spark):
    item = sentence(40, tag="q")
    w = item.split()
    docs = [(1, sentence(50) + " " + item), (2, " ".join(w[30:] + ["zz"] + w[10:30] + ["yy"] + w[:10])), (3, sentence(80)),
            (4, " ".join(w[:12]) + " " + sentence(60)), (5, item.upper().replace(" ", ", "))]
    bad = {r.id: r for r in tiling.contaminated(docs_frame(spark, docs), items_frame(spark, [(9, item)])).collect()}
    assert set(bad) == {1, 2, 5} and all(b.best_item == 9 and b.coverage == 1 for b in bad.values())
    d = docs_frame(spark, docs).withColumn("key", F.lit(0))
    kept = tiling.clean_documents(d, items_frame(spark, [(9, item)]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4] and kept.columns == d.columns


def test_small_bit_table_changes_nothing(spark):
    item = sentence(30, tag="q")
    docs = docs_frame(spark, [(k, sentence(200, k * 7)) for k in range(20)] + [(99, item)])
    got = tiling.contaminated(docs, items_frame(spark, [(1, item)]), bits=64).collect()
    assert [r.id for r in got] == [99]


def test_repeated_passages_cost_their_length():
    seeds = list(range(2))
    many = [np.arange(k, 40_000, 2) for k in seeds]
    few = [np.arange(k, 60, 2) for k in seeds]
    assert sum(t[2] for t in tiling.tiles(seeds, many, few)) == 64


def test_odd_rows(spark):
    items = items_frame(spark, [(1, None), (2, ""), (3, "four words are few"), (None, sentence(20, tag="n")),
                                (5, sentence(20, tag="five")), (5, sentence(20, tag="six"))])
    rows = odd_documents() + [(50, sentence(20, tag="six")), (51, sentence(20, tag="n")), (51, sentence(20, tag="n"))]
    d = docs_frame(spark, rows)
    assert sorted(r.id for r in tiling.contaminated(d, items).collect()) == [50, 51]
    assert tiling.clean_documents(d, items).count() == len(rows) - 3
    none = items_frame(spark, [])
    assert tiling.clean_documents(d, none).count() == len(rows)
    assert tiling.clean_documents(docs_frame(spark, []), items).count() == 0


def test_columns_of_any_name_stay(spark):
    d = docs_frame(spark, [(1, sentence(40)), (2, sentence(40, 100))]).withColumns({"_bad": F.lit(1), "key": F.lit("k"), "id": F.lit(3)})
    kept = tiling.clean_documents(d, items_frame(spark, [(9, sentence(40))]))
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_a_common_stem_pairs_nothing(spark):
    """Every item and document starts with the same words; pairs are met only where enough is shared."""
    stem = sentence(11, tag="stem")
    items = [(k, stem + " " + sentence(60, k * 100, "i")) for k in range(30)]
    docs = [(d, stem + " " + sentence(40, d * 100, "d")) for d in range(40)] + [(100, sentence(9, tag="x") + " " + items[7][1])]
    met = tiling.coverage(docs_frame(spark, docs), items_frame(spark, items), least=0.5).collect()
    assert [(r.id, r.item_id, r.coverage) for r in met] == [(100, 7, 1.0)]
    every = tiling.coverage(docs_frame(spark, docs), items_frame(spark, items))
    assert every.count() == 41 * 30 and every.where("covered = 11").count() == 41 * 30 - 1


def test_every_pair_at_the_threshold_is_met(spark):
    """Pieces of five to nine words in any order, some windows frequent: no pair of the threshold or more is lost."""
    rng = random.Random(8)
    items = [(k, " ".join(f"c{rng.randrange(12)}" if j % 20 < 8 else f"i{k}x{j}" for j in range(rng.randint(8, 60)))) for k in range(12)]
    docs = []
    for d in range(80):
        w = items[d % 12][1].split()
        parts = [w[c:c + rng.randint(5, 9)] for c in rng.sample(range(len(w)), min(5, len(w)))]
        docs.append((d, " filler ".join(" ".join(p) for p in parts)))
    frames = docs_frame(spark, docs), items_frame(spark, items)
    for least in (0.2, 0.5, 0.9, 1.0):
        pair = lambda r: (r.id, r.item_id, r.covered)
        want = {pair(r) for r in tiling.coverage(*frames).where(F.col("coverage") >= least).collect()}
        got = {pair(r) for r in tiling.coverage(*frames, least=least).where(F.col("coverage") >= least).collect()}
        assert want and got == want
