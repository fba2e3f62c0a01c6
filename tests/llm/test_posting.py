import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import posting

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x)], SCHEMA)


def exact(x, ids, every=20, k=20):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    out = {}
    for q in range(len(x)):
        if ids[q] % every == 0:
            s = x @ x[q]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hit = total = 0
    for q, w in want.items():
        hit += len({i for i, _ in w} & {r.vec_id for r in got if r.query_id == q})
        total += len(w)
    return hit / total


@pytest.mark.parametrize("kind", ["clusters", "uniform", "lengths"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(posting, "BLOCK_ROWS", 20)   # several blocks a list
    rng = np.random.default_rng(3)
    n = 1_500
    x = rng.normal(size=(n, 16))
    if kind == "clusters":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, n)] * 4 + x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    got = posting.nearest(frame(spark, x)).collect()
    want = exact(x, np.arange(n))
    assert recall(got, want) >= 0.9
    xd = x.astype(np.float64)
    for r in got:
        assert abs(r.score - xd[r.query_id] @ xd[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for v in ranks.values():
        v.sort()
        assert [a[0] for a in v] == list(range(1, 21)) and [a[1:] for a in v] == sorted(a[1:] for a in v)


def test_hot_vector_ties_and_few_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.normal(size=8), (400, 1)), rng.normal(size=(100, 8))]).astype(np.float32)
    got = posting.nearest(frame(spark, x)).where("query_id = 20").orderBy("rank").collect()
    top = [r.vec_id for r in got if abs(r.score - got[0].score) < 1e-12]
    assert top == sorted(top) and 20 not in top and got[0].vec_id in (0, *range(400, 500))
    few = posting.nearest(frame(spark, x[398:403], [0, 1, 2, 20, 40])).collect()
    assert {(r.query_id, r.rank) for r in few} == {(q, k) for q in (0, 20, 40) for k in range(1, 5)}


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0),
            (5, [float("inf"), 1.0], 0), (6, [None, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0], 0), (8, [0.25, 0.25], 0), (8, [0.25, 0.25], 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "list": F.lit("l"), "score": F.lit(0)})
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in posting.nearest(d).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.25)]
    assert posting.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_are_balanced_and_the_walk_reaches_them_all():
    x = np.random.default_rng(1).normal(size=(2_000, 6))
    index = posting.fit_lists(x, 50_000, float(np.linalg.norm(x, axis=1).max()))
    sizes = np.bincount(np.concatenate(index.places(x)), minlength=len(index.centroids))
    assert len(index.centroids) >= 32 and sizes.max() < 12 * sizes.mean()
    assert sorted(index.probe(x[0], 1e9)) == list(range(len(index.centroids)))


def test_many_equal_products_give_the_smallest_ids():
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(2_000), rng.normal(size=(2_000, 5))]   # distinct vectors, all with product 1
    ids = rng.permutation(2_000)
    entry = lambda vec, key, own: {"key": key, "vec": vec, "ids": own}
    blocks = np.array_split(np.arange(2_000), 3)
    vec_t, key_t, ids_t = pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64())
    rows = [[entry(x[i].tolist(), str(i).encode(), [int(ids[i])]) for i in b] for b in blocks]
    ask = [{"key": b"q", "vec": [1.0, 0, 0, 0, 0, 0]}]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 3, pa.int32()), pa.array([0] * 3, pa.int64()), pa.array([ask] * 3, pa.list_(pa.struct([("key", key_t), ("vec", vec_t)]))),
         pa.array(rows, pa.list_(pa.struct([("key", key_t), ("vec", vec_t), ("ids", ids_t)])))], ["list", "ask", "asks", "rows"])
    got = [i for out in posting._best(20)([batch]) for i in out.column(3).to_pylist()]
    assert sorted(i for own in got for i in own) == list(range(20))
