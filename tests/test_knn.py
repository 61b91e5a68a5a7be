"""The nearest-neighbour join against all pairs."""

import numpy as np
import pytest

from lumenfold.operators import knn


def brute(q, r, k, keyed):
    out = []
    for qi, qk, qx in q:
        near = sorted((float(sum((np.array(qx) - np.array(rx)) ** 2)), ri) for ri, rk, rx in r if not keyed or rk == qk)[:k]
        out += [(qi, ri, n + 1, d) for n, (d, ri) in enumerate(near)]
    return sorted(out)


def run(spark, q, r, k, keyed, **options):
    axes = [f"a{i}" for i in range(len(q[0][2]) if q else 2)]
    schema = "id long, g string, " + ", ".join(f"{a} double" for a in axes)
    df = [spark.createDataFrame([(i, g, *map(float, x)) for i, g, x in rows], schema) for rows in (q, r)]
    got = knn.knn_join(*df, k, "id", "id", axes, "g" if keyed else None, **options).collect()
    return sorted((x["id"], x["ref_id"], x["rank"], x["d2"]) for x in got)


@pytest.mark.parametrize("shape", ["uniform", "grid", "clusters", "line"])
@pytest.mark.parametrize("axes", [1, 2, 3])
def test_against_all_pairs(spark, shape, axes):
    rng = np.random.default_rng(axes)

    def points(n, seed):
        rng = np.random.default_rng(seed)
        if shape == "grid":  # ties everywhere, and a third of all points in one place
            x = rng.integers(0, 6, (n, axes)).astype(float)
            x[: n // 3] = 3.0
            return x
        if shape == "clusters":
            return rng.normal(0, 0.01, (n, axes)) + rng.integers(0, 4, (n, 1)) * 100
        if shape == "line":
            return np.repeat(rng.normal(0, 1, (n, 1)), axes, 1)
        return rng.uniform(0, 1, (n, axes))

    q = [(i, "ab"[i % 2], tuple(x)) for i, x in enumerate(points(150, 5) + (2.0 if shape == "clusters" else 0.0))]
    r = [(int(i), "a" if i % 5 else "b", tuple(x)) for i, x in zip(rng.permutation(400), points(400, 6), strict=True)]
    for keyed in (False, True):
        got, want = run(spark, q, r, 4, keyed, leaf=30, crowd=40), brute(q, r, 4, keyed)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_points(spark):
    q = [(0, "a", (0.0, 0.0)), (1, "b", (1.0, 1.0)), (2, "c", (2.0, 2.0)), (3, None, (0.0, 0.0)), (4, "a", (float("nan"), 0.0))]
    r = [(7, "a", (0.0, 1.0)), (8, "a", (0.0, 1.0)), (9, "b", (5.0, 5.0)), (10, None, (0.0, 0.0))]
    assert run(spark, q, r, 3, True) == [(0, 7, 1, 1.0), (0, 8, 2, 1.0), (1, 9, 1, 32.0)]
    assert run(spark, q, [], 3, True) == [] and run(spark, [], r, 3, True) == []
    assert len(run(spark, q, r, 9, False)) == 4 * 4


def test_cells_are_bounded():
    """Cuts share points out, and equal points end in one cell without endless cuts."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    cells = knn.Cells()
    cells.grow(0, x, 50)
    sizes = np.bincount(cells.home(np.zeros(5000, int), x), minlength=cells.n)
    assert cells.n == 50 and sizes.max() < 3 * 5000 / 50
    same = knn.Cells()
    same.grow(0, np.ones((100, 2)), 8)
    assert same.n == 1
