from hashlib import sha256

from pyspark.sql import functions as F

from kpiforge.llm import merkle
from tests.llm.helpers import DOCS, docs_frame, odd_documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def brute_leaf(row):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*(text(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def brute(rows, lower):
    """Per row, as a list by leaf order: id, leaf, subroot, root, proof, folded root."""
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, groups = [], []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang),
                     key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
        groups.append(own)
        trees.append(levels_of([brute_leaf(r) for r in own]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for g, (own, tree) in enumerate(zip(groups, trees)):
        for k, r in enumerate(own):
            siblings, claimed = [], brute_leaf(lower(r))
            for i, nodes in [(k, tree), (g, top)]:
                for level in nodes[:-1]:
                    run = i - i % 8
                    before, after = level[run:i], level[i + 1:run + 8]
                    siblings += before + after
                    claimed, i = h(*before, claimed, *after), i // 8
            out.append((r["doc_id"], brute_leaf(r), tree[-1][0], top[-1][0], h(*siblings), claimed))
    return out


def run(docs):
    m = merkle.build(docs, tampered={"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))})
    got = merkle.proofs(m).collect()
    return m, sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str), got


def lowered(r):
    return {**r, "text": r["text"].lower()} if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 3 == 0 else r


def test_positions_are_those_of_a_sequential_log():
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 513, 600]:
        levels = levels_of([h(str(k)) for k in range(n)])
        log, done = [], [0] * len(levels)
        for k in range(n):   # append each node as soon as its last leaf is in
            for level in range(len(levels)):
                if level == 0 or (k + 1) % 8 ** level == 0 or k == n - 1:
                    log.append(levels[level][done[level]])
                    done[level] += 1
        assert log == merkle.append_nodes(levels[0], merkle.height(n))
        for level, nodes in enumerate(levels):
            for i, digest in enumerate(nodes):
                assert log[merkle.position(level, i, n)] == digest


def test_odd_rows_equal_brute_force(spark):
    docs = docs_frame(spark, odd_documents()).withColumn(
        "lang", F.when(F.col("doc_id") == 4, F.lit(None)).when(F.col("doc_id") == 5, F.lit("é")).otherwise(F.col("lang")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    for extra in ("grp", "idx", "leaf", "row", "log", "n", "path"):
        docs = docs.withColumn(extra, F.lit("clash"))
    rows = [r.asDict() for r in docs.collect()]
    _, got, full = run(docs)
    assert got == sorted(brute(rows, lowered), key=str)
    assert all(r.verified == (r.folded_root == r.root) for r in full)


def test_several_rounds_and_the_whole_log(spark):
    rows = [(k, f"Text {k % 9}", "en" if k % 50 else None, "s", k) for k in range(6_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    m, got, full = run(docs)
    want = brute([r.asDict() for r in docs.collect()], lowered)
    assert got == sorted(want, key=str) and len(m.rounds) == 2
    assert {r.id for r in full if not r.verified} == {k for k in range(0, 6_000, 3)}
    log = merkle.append_log(m).where("lang = 'en'").orderBy("position").collect()
    own = [h_ for i, h_ in sorted((r[0], r[1]) for r in want if r[0] % 50)]
    assert [r.position for r in log] == list(range(len(log)))
    assert [r.digest for r in log] == merkle.append_nodes(own, merkle.height(len(own)))


def test_one_row_and_no_row(spark):
    m, got, _ = run(docs_frame(spark, [(8, "A b")]))
    leaf = brute_leaf({"doc_id": 8, "source": "a", "lang": "en", "n_chars": 3, "text": "A b"})
    assert got == [(8, leaf, leaf, leaf, h(), leaf)] and m.root == leaf
    m, got, _ = run(docs_frame(spark, [(8, "A b")]).limit(0))
    assert got == [] and m.root is None
