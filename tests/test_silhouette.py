"""Silhouettes compare all pairs of rows, whatever their number."""

import numpy as np
import pytest

from kpiforge.ml import silhouette
from kpiforge.ml.silhouette import pair_sums, silhouettes


def plain(x, labels):
    """Score by score, a row's distances to all rows at once."""
    kinds, at = np.unique(labels, return_inverse=True)
    size, out = np.bincount(at), 0.0
    inside = np.eye(len(kinds))[at]
    for a in range(0, len(x), 500):
        d = np.sqrt(sum((x[a:a + 500, None, k] - x[None, :, k]) ** 2 for k in range(x.shape[1])))
        g, i = at[a:a + 500], np.arange(len(d))
        total = d @ inside
        near = total[i, g] / np.maximum(size[g] - 1, 1)
        mean = total / size
        mean[i, g] = np.inf
        far = mean.min(axis=1)
        most = np.maximum(near, far)
        ok = (size[g] > 1) & (most > 0)
        out += np.where(ok, (far - near) / np.where(ok, most, 1), 0).sum()
    return out / len(x)


def test_more_rows_than_the_former_bound_are_exact(spark):
    rng = np.random.default_rng(5)
    x, which = rng.normal(size=(20_600, 2)), rng.integers(0, 3, 20_600)
    x[:, 0] += which
    df = spark.createDataFrame([(i, *map(float, r), int(g)) for i, (r, g) in enumerate(zip(x, which))], "id long, a double, b double, label int")
    got = silhouettes(df, ["a", "b"], ["label"], ["id"]).first()
    assert (got.groups, got.n, got.error_bound) == (3, 20_600, 0)
    assert got.silhouette == pytest.approx(plain(x, which), abs=1e-9)


def test_many_blocks_and_labellings_at_once(spark, monkeypatch):
    """Null labels, labels of one row, repeated ids, equal rows and column names that the job itself might use."""
    for name, rows in (("LEAST_ROWS", 150), ("PACK_ROWS", 200), ("PART_ROWS", 70), ("MAX_CELLS", 30)):
        monkeypatch.setattr(silhouette, name, rows)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1_100, 3))
    x[:60], x[60:70] = x[0], x[0] + 1e-9
    a, b, m = (rng.integers(0, k, len(x)) for k in (4, 3, 20))
    a[500] = 9
    df = spark.createDataFrame([(1, *map(float, r), None if i % 9 == 0 else str(a[i]), int(b[i]), int(m[i])) for i, r in enumerate(x)],
                               "id long, p double, u double, block double, a string, b int, m int").repartition(3)
    got = {r.labelling: r for r in silhouettes(df, ["p", "u", "block"], ["a", "b", "m"], ["id"]).collect()}
    has = np.arange(len(x)) % 9 != 0
    for name, want, n in (("a", plain(x[has], a[has]), has.sum()), ("b", plain(x, b), len(x)), ("m", plain(x, m), len(x))):
        assert got[name].n == n and got[name].silhouette == pytest.approx(want, abs=1e-9) and got[name].error_bound == 0


def test_sums_of_two_blocks_go_both_ways():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(700, 2)), rng.normal(size=(300, 2))
    xc, yc = (np.c_[rng.integers(-1, 2, n), rng.integers(2, 5, n)] for n in (700, 300))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    inside = [np.stack([(c == g).any(axis=1) for g in range(5)], axis=1).astype(float) for c in (xc, yc)]
    own, back = pair_sums(x, xc, y, yc, 5)
    assert np.allclose(own, d @ inside[1]) and np.allclose(back, d.T @ inside[0])
    alone = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) @ inside[0]
    assert all(np.allclose(s, alone) for s in pair_sums(x, xc, x, xc, 5))
