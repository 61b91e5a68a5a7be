"""Quantiles of array elements by key against NumPy."""

import numpy as np

from lumenfold.functions import ranks


def test_order_of_bits():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e99, np.inf])
    b = ranks.ordered_bits(x)
    assert (np.diff(b.astype(object)) >= 0).all() and b[4] == b[5]
    assert np.array_equal(ranks.from_bits(b), x)


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        k = ["a", "b", "c"][0 if i % 3 else int(rng.integers(3))]
        x = [float(rng.normal()), float(rng.integers(-3, 3)), 7.0, float(rng.lognormal(0, 20)), -0.0 if i % 2 else 0.0, float(np.float32(rng.normal()))]
        rows.append((k, x))
    rows += [("b", [float("nan")] * 6), ("b", None), (None, [1.0] * 6), ("d", [3.0] * 6), ("e", [float("nan"), 1.0, float("inf"), -1.0, 0.0, 2.0]), ("c", [None, 1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(5)
    qs = [0.0, 0.1, 0.5, 0.995, 1.0]
    keys, got = ranks.array_quantiles(df, "k", "x", 6, qs)
    assert keys == list("abcde")
    for i, k in enumerate(keys):
        own = np.array([[np.nan if v is None else v for v in x] for kk, x in rows if kk == k and x is not None])
        for p in range(6):
            v = own[:, p][~np.isnan(own[:, p])]
            want = np.quantile(v, qs) if len(v) else np.full(len(qs), np.nan)
            ok = np.isfinite(want)
            assert np.allclose(got[i, ok, p], want[ok], rtol=1e-12, atol=0) and len(v) == 0 or np.array_equal(got[i, :, p], want, equal_nan=True) or np.allclose(got[i, ok, p], want[ok], rtol=1e-12), (k, p)
    keys, got = ranks.array_quantiles(df, "k", "x", 6, [0.5], of=lambda k, x: np.abs(x - k[:, None]), keys=["b", "a"])
    own = np.array([x for kk, x in rows if kk == "a"])
    assert np.allclose(got[1, 0], np.median(np.abs(own - 1), axis=0))
    assert ranks.array_quantiles(df.limit(0), "k", "x", 6, [0.5])[0] == []
