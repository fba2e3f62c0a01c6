import random

import numpy as np
from pyspark.sql import functions as F

from kpiforge.llm import toxicity
from tests.llm.helpers import docs_frame, odd_documents

CLEAN = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "tel", "sim", "pod", "gur", "wex")]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(CLEAN) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "zorg" + rng.choice(CLEAN)]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_unseen_word_forms(spark):
    rows, labels = corpus(600, 1)
    model = toxicity.fit_chain(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    other, truth = corpus(300, 2)
    got = {r.doc_id: r.p_toxic for r in toxicity.toxic_documents(docs_frame(spark, other), model).collect()}
    want = {i for i, t in truth if t}
    assert len(want & got.keys()) >= 0.95 * len(want) and not got.keys() - want
    kept = toxicity.clean_documents(docs_frame(spark, other).withColumn("p", F.lit(1)), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in other} - got.keys()
    unseen = docs_frame(spark, [(1, " ".join(CLEAN[:15]) + " zorgxyzzy nasty")])
    assert toxicity.toxic_documents(unseen, model).count() == 1


def test_later_links_see_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200).astype(float)
    rows = np.arange(200)
    cols = np.arange(200)   # one feature per row: in-sample predictions would be perfect
    w = toxicity.fit_links(rows, cols, np.stack([y, y], axis=1), rows % 3, 200)
    assert len(w[0]) == 201 and len(w[1]) == 202
    assert abs(w[1][200]) < 3   # held-out predictions are uninformative here, so the link gets little weight


def test_severity_labels():
    got = toxicity.categories(np.array([1, 1, 1, 0]), np.array([0.1, 0.5, 0.3, 0.9]))
    assert got.tolist() == [[0, 1, 1], [1, 0, 1], [1, 0, 1], [0, 0, 0]]


def test_odd_rows_and_missing_labels(spark):
    rows, labels = corpus(120, 3)
    lab = spark.createDataFrame([*labels, (0, None), (None, 1), (10 ** 9, 1)], "doc_id long, toxic int")
    model = toxicity.fit_chain(docs_frame(spark, rows), lab)
    d = docs_frame(spark, odd_documents()).withColumn("scores", F.lit(0))
    assert toxicity.clean_documents(d, model).count() == len(odd_documents())
    none = toxicity.fit_chain(docs_frame(spark, rows), lab.where("toxic = 0"))
    assert toxicity.toxic_documents(docs_frame(spark, rows), none).count() == 0
    empty = toxicity.fit_chain(docs_frame(spark, []), lab)
    assert toxicity.toxic_documents(docs_frame(spark, []), empty).count() == 0


def test_chain_equals_brute_force(spark):
    rows, labels = corpus(300, 4)
    model = toxicity.fit_chain(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def brute(text):   # one link after the other, feature by feature
        have = {f for w in set(text.lower().split()) for f in [w, *(w[:n] + "~" for n in range(3, 9) if len(w) > n)]}
        p = []
        for w in model.weights:
            z = w[-1] + sum(w[k] for f, k in model.selected.items() if f in have) + sum(w[len(model.selected) + j] * q for j, q in enumerate(p))
            p.append(1 / (1 + np.exp(-z)))
        return p

    other, _ = corpus(200, 5)
    want = {i: brute(t) for i, t in other}
    got = {r.doc_id: (r.p_severe, r.p_mild, r.p_toxic) for r in toxicity.toxic_documents(docs_frame(spark, other), model).collect()}
    assert got.keys() == {i for i, p in want.items() if p[-1] >= model.threshold}
    assert all(np.allclose(got[i], want[i]) for i in got)


def test_links_reach_the_optimum_of_a_plain_solver():
    rng = np.random.default_rng(1)
    x = (rng.random((80, 6)) < 0.4).astype(float)
    y = (x[:, 0] + rng.random(80) > 0.9).astype(float)
    rows, cols = np.nonzero(x)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    full, w = np.c_[x, np.ones(80)], np.zeros(7)
    for _ in range(50):   # Newton's method on the same objective
        p = 1 / (1 + np.exp(-full @ w))
        ridge = np.r_[np.full(6, 1e-4), 0]
        w = w - np.linalg.solve(full.T * (weight * p * (1 - p)) @ full + np.diag(ridge), full.T @ (weight * (p - y)) + ridge * w)
    got = toxicity.logistic_fit(rows, cols, np.zeros((80, 0)), y, 6, steps=20_000)
    assert np.allclose(got, w, atol=1e-3)


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    assert 0.3 < toxicity.best_threshold(p, y) < 0.8
    assert toxicity.best_threshold(np.array([0.9, 0.5, 0.4, 0.1]), np.array([1, 0, 1, 0])) < 0.4
    assert 0 < toxicity.best_threshold(np.full(4, 0.5), np.array([1, 1, 0, 1])) < 0.5


def test_text_without_evidence_is_clean_and_names_may_clash(spark):
    rows, labels = corpus(150, 6)
    docs = docs_frame(spark, rows + [(9_000 + k, t) for k, t in enumerate([None, "", "qq rr ss", "unknown words only"])])
    for extra in ("toxic", "l_id", "id", "feats", "p", "hits"):
        docs = docs.withColumn(extra, F.lit("clash"))
    model = toxicity.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id for r in toxicity.toxic_documents(docs, model).collect()}
    assert found == {i for i, t in labels if t}
    assert toxicity.clean_documents(docs, model).columns == docs.columns
