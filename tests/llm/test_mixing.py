import re

import pytest
from pyspark.sql import functions as F

from kpiforge.llm import mixing
from tests.llm.helpers import docs_frame, odd_documents, sentence


def water_fill(sizes, weights, share):
    """Targets by the stated rule: those above twice their size stop there, the excess is shared again."""
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * weights[s] / w > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        full |= over


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_targets_and_taken_words(spark, bucket_rows):
    rows = [(i, sentence(1 + i * 7 % 40), ["a", "b", "c", "d", None][0 if i % 3 == 0 else i % 5]) for i in range(600)]
    out = mixing.mix(docs_frame(spark, rows), bucket_rows=bucket_rows)
    got = out.select("row.doc_id", "size", "source", "source_size", "target", "copies", "taken").collect()
    assert len(got) == 600
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    budget = 1.5 * sum(sizes.values())
    assert budget - 40 <= sum(taken.values()) <= budget
    assert all(abs(taken[s] - want[s]) <= 2 * 40 for s in sizes)
    again = mixing.mix(docs_frame(spark, rows, parts=7), bucket_rows=bucket_rows).select("row.doc_id", "copies").collect()
    assert sorted(again) == sorted((r.doc_id, r.copies) for r in got)


def test_cut_is_the_brute_force_queue(spark):
    rows = [(i, sentence(1 + i % 9), "ab"[i % 2]) for i in range(200)]
    d = docs_frame(spark, rows)
    got = {r.doc_id: r.copies for r in mixing.mix(d, bucket_rows=5).select("row.doc_id", "copies").collect()}
    h = {r.doc_id: (r.h, r.doc_id, r.t) for r in d.select("doc_id", F.xxhash64("text").alias("t")).select(
        "doc_id", "t", F.xxhash64(F.lit(7), "doc_id", "t").alias("h")).collect()}
    size, queue = {i: 1 + i % 9 for i in range(200)}, []
    for place, (s, w) in enumerate((("a", 5), ("b", 2)), 1):
        own = sorted((i for i, _, x in rows if x == s), key=h.get)
        upto = 0
        for epoch in range(2):
            for i in own:
                upto += size[i]
                queue.append((upto / w, place, epoch, *h[i], i))
    want, room = dict.fromkeys(size, 0), 1.5 * sum(size.values())
    for *_, i in sorted(queue):
        if size[i] > room:
            break
        room -= size[i]
        want[i] += 1
    assert got == want


def test_odd_rows_and_clashing_columns(spark):
    d = docs_frame(spark, odd_documents()).withColumns({"size": F.lit("x"), "target": F.lit(1), "h": F.lit(2)})
    out = mixing.mix(d)
    assert out.count() == len(odd_documents())
    assert mixing.replayed(out).columns == d.columns
    assert out.where("copies > 2 OR taken > 2 * size").count() == 0


def test_empty_table(spark):
    out = mixing.mix(docs_frame(spark, []))
    assert out.count() == 0 and mixing.replayed(out).count() == 0
