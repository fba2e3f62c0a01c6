import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, v string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for i, lab, v in ok:
        if i % 100 or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        scored = sorted(((-dot(v, w), j, m) for j, m, w in ok if j != i))
        for s, j, m in [x for x in scored if x[2] == lab][:5]:
            fit = [(n, t) for t, n, k in scored if k != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r + 1, n, -s, -t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    got = hard_negatives.mine(frame(spark, rows), lambda x: x % 100 == 0,
                              relabel=lambda x, lab: F.when(x % 7 == 0, (lab + 1) % 10).otherwise(lab))
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("kind", ["uniform", "ties", "clusters"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIP_ROWS", 300)   # several cells
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 5)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1_200, 12))
    if kind == "ties":
        x = rng.integers(0, 2, size=(1_200, 3)) / 2
    if kind == "clusters":
        x = rng.normal(size=(10, 12))[rng.integers(0, 10, 1_200)] + x / 4
    rows = [(k, [float(np.float32(c)) for c in v], int(rng.integers(0, 10))) for k, v in enumerate(x)]
    rows[3] = (3, None, 1)
    rows[4] = (4, [float("nan")] * 12, 1)
    rows[5] = (5, [None] + [1.0] * 11, 1)
    rows[6] = (6, rows[6][1], None)
    rows[7] = (None, rows[7][1], 1)
    rows[8] = (8, [], 1)
    rows[9] = (9, rows[9][1][:2], 1)
    rows[10] = (10, [float("inf")] + [1.0] * 11, 1)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_repeated_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1),
            (3, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (4, [0.5, -1.0], 3)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e9], 1), (2, [1.0], 1)])


@pytest.mark.parametrize("size,width", [(1, 1), (300, 64), (70_000, 64), (2**20, 900), (2**30, 2)])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, width)), rng.integers(-size, size + 1, (9, width))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.products(a, b).tolist() == want
    assert all(p // 2 * (p // 2) * hard_negatives.DEPTH < hard_negatives.EXACT for p in hard_negatives.small_primes())
