"""Robust lines: all detectors at once, and distributed rounds, against one line at a time."""

import numpy as np
import pytest

from lumenfold.operators import kernels, spectra


def controls():
    rng = np.random.default_rng(2)
    out = {}
    for name, n, shift in (("a", 300, 0.0), ("b", 120, 5e4), ("c", 1, 0.0), ("d", 40, 0.0), ("e", 60, 0.0)):
        u = rng.lognormal(5, 1, n)
        Y = np.outer(u, [0.2, 1.0, -0.3, 0.0, 0.7]) + rng.normal(0, 3, (n, 5)) + shift
        Y[rng.random(n) < 0.1] += rng.normal(0, 400, 5)
        if name == "d":
            Y[:] = Y[0]  # no spread
        if name == "e":
            Y = np.outer(u, [0.2, 1.0, -0.3, 0.0, 0.7])  # exact lines: no scale
        out[name] = Y
    return out


def test_all_columns_at_once():
    for Y in controls().values():
        at = int(Y.mean(0).argmax())
        slopes, ok = kernels.huber_lines(Y[:, at].copy(), Y)
        if len(Y) < 2 or np.ptp(Y[:, at]) == 0:
            assert (slopes == 0).all()
            continue
        one = [kernels.huber_line(Y[:, at], y) for y in Y.T]
        assert ok.tolist() == [o for _, _, o in one]
        assert np.allclose(slopes, [s for _, s, _ in one], rtol=1e-6, atol=1e-7)


@pytest.mark.parametrize("group", [10_000, 50])
def test_both_routes(spark, group):
    data = controls()
    rows = [(k, y.tolist()) for k, Y in data.items() for y in Y] + [(None, [1.0] * 5), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(4)
    got = {r["k"]: np.array(r["spectrum"], dtype=float) for r in spectra.robust_spectra(df, "k", "x", 5, group=group).collect()}
    assert sorted(got) == sorted(data)
    for k, Y in data.items():
        at = int(Y.mean(0).argmax())
        if len(Y) < 2 or np.ptp(Y[:, at]) == 0:
            assert np.isnan(got[k]).all()  # nothing to divide by
            continue
        raw = np.array([kernels.huber_line(Y[:, at], y)[1] for y in Y.T])
        assert np.allclose(got[k], raw / raw.max(), rtol=1e-5, atol=1e-6), k
