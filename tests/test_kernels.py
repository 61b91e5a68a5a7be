"""Algebraic properties of the kernels."""

import numpy as np
import pytest

from lumenfold.functions.biexponential import Biexponential, width_for
from lumenfold.operators import contours, gate, kernels, spectra

RNG = np.random.default_rng(0)
S = RNG.random((3, 8)) + 0.1
U = RNG.random((60, 3)) * 100
X = U @ S
A = RNG.random((4, 8))


def test_exact_recovery():
    for P in (kernels.ols(S), kernels.ols_normal(S), kernels.wls(S, RNG.random(8) + 0.1), kernels.wls_normal(S, RNG.random(8) + 0.1)):
        assert np.allclose(X @ P.T, U)
    assert np.allclose(kernels.wls_each(X, S, 1 / X), U)
    assert np.allclose(kernels.poisson(X, S, X @ kernels.ols(S).T), U)


def test_residual_is_orthogonal_and_weights_of_one_are_ols():
    Y = X + RNG.normal(size=X.shape)
    P = kernels.ols(S)
    assert np.allclose((Y - (Y @ P.T) @ S) @ S.T, 0, atol=1e-8)
    assert np.allclose(kernels.wls(S, np.ones(8)), P) and np.allclose(kernels.wls_normal(S, np.ones(8)), P)
    order = RNG.permutation(8)
    assert np.allclose(Y[:, order] @ kernels.ols(S[:, order]).T, Y @ P.T)


def test_poisson_lowers_the_deviance_and_keeps_the_start_without_steps():
    Y = RNG.poisson(X).astype(float)
    start = Y @ kernels.ols(S).T
    fit = kernels.poisson(Y, S, start)
    dev = lambda u: (np.maximum(Y, 1e-6) * np.log(np.maximum(Y, 1e-6) / np.maximum(u @ S, 1e-6)) - Y + u @ S).sum(1)
    assert (dev(fit) <= dev(np.maximum(start, 1e-6)) + 1e-6).all()
    assert np.allclose(kernels.poisson(Y, S, start, iterations=0), np.maximum(start, 1e-6))


def test_background_is_found_and_ties_go_to_the_lowest_index():
    index = RNG.integers(0, 4, len(X))
    Y = X + 20 * A[index]
    for rule in (kernels.af_by_spill, kernels.af_by_joint_cov):
        assert (rule(Y, S, A) == index).mean() > 0.95
    assert np.allclose(kernels.with_af(Y, S, A, index), np.hstack([U, np.full((len(X), 1), 20.0)]))
    twice = np.vstack([A[1], A[1], A[2]])
    for rule in (kernels.af_by_spill, kernels.af_by_residual, kernels.af_by_joint_cov):
        assert not (rule(Y, S, twice) == 1).any()


def test_results_do_not_depend_on_batches():
    Y = X + 20 * A[RNG.integers(0, 4, len(X))]
    lib = {1: np.vstack([S[1], S[1] + 0.2 * RNG.random(8)])}
    for f in (lambda Z: kernels.af_by_joint_cov(Z, S, A), lambda Z: kernels.greedy(Z, S, lib, np.zeros(3)), lambda Z: kernels.joint(Z, S, A, lib, np.zeros(3))[0], lambda Z: kernels.poisson(Z, S, Z @ kernels.ols(S).T)):
        assert np.allclose(f(Y), np.concatenate([f(Y[:7]), f(Y[7:])]))


def test_variants_are_taken_and_never_raise_the_residual():
    lib = {1: np.vstack([S[1], S[1] + 0.2 * RNG.random(8)])}
    Z = U @ np.vstack([S[0], lib[1][1], S[2]])
    assert np.allclose(kernels.greedy(Z, S, lib, np.zeros(3)), U)
    assert np.allclose(kernels.greedy(X, S, lib, np.zeros(3)), U)
    assert np.allclose(kernels.greedy(Z, S, lib, np.full(3, 1e9)), Z @ kernels.ols(S).T)
    noisy = Z + RNG.normal(size=Z.shape)
    P = kernels.ols(S)

    def err(lib):
        u, amount, index = kernels.joint(noisy, S, A, lib, np.zeros(3))
        return u, noisy - amount[:, None] * A[index]

    u, Y = err(lib)
    u0, Y0 = err({})
    assert np.allclose(Y, Y0) and np.allclose(u0, Y0 @ P.T)


def test_variant_index_and_cosine_factor():
    V = np.vstack([S[1], S[1] + 0.3 * RNG.random(8)])
    Z = U @ np.vstack([S[0], V[1], S[2]])
    assert (kernels.variants(Z, S, 1, V) == 1).mean() > 0.9
    assert set(kernels.variants(Z, S, 1, V, by_cosine=True)) <= {0, 1}


def test_necessity_and_huber():
    n = kernels.necessity(S, {0: 0.5 * RNG.normal(size=(9, 8)), 1: 0.001 * RNG.normal(size=(9, 8))})
    assert n.max() == 1 and n[2] == 0 and n[0] > n[1]
    x = np.arange(40.0)
    y = 2 * x + 3
    y[5] = 900
    b, m, ok = kernels.huber_line(x, y)
    assert ok and abs(m - 2) < 0.05 and abs(b - 3) < 1.5


def test_som_shapes():
    two = np.vstack([RNG.normal(0, 0.1, (400, 2)), RNG.normal(5, 0.1, (400, 2))])
    code = kernels.som(two, 3)
    assert code.shape == (9, 2) and min(np.linalg.norm(code - [5, 5], axis=1)) < 0.3 and min(np.linalg.norm(code, axis=1)) < 0.3
    assert len(kernels.som(two[:60], 10)) == 16  # few events: a smaller map


def test_spectra_helpers():
    c = spectra.cosine_cross(S, A)
    assert c.shape == (3, 4) and np.allclose(np.diag(spectra.cosine_matrix(S)), 1, atol=1e-6)
    assert spectra.deduplicate(np.vstack([S, S[0] * 1.001, S[2]])) == [0, 1, 2] or spectra.deduplicate(np.vstack([S, S])) == spectra.deduplicate(S)
    assert spectra.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    assert spectra.hotspot_matrix(S).shape == (3, 3)
    kept, best, _ = spectra.qc_background(np.vstack([S[0], A]), S)
    assert best[0] > 0.99 and len(kept) < 5
    assert len(spectra.qc_background(np.vstack([S[0], A]), S, remove=False)[0]) == 5
    with pytest.raises(ValueError):
        spectra.background_library(RNG.random((20, 8)), S)


def test_biexponential_is_monotone_and_invertible():
    for w in (-10.0, -100.0, -1000.0):
        b = Biexponential(width=w)
        assert (np.diff(b.values) > 0).all() and np.allclose(b.inverse(b([0.0, 100.0, 1e4, 2e5])), [0, 100, 1e4, 2e5], rtol=1e-3, atol=2)
    assert width_for(-5000) < width_for(-500) < width_for(0)


def crossings(gx, gy, z, level):
    """All points where a level meets an edge of the grid, edge by edge."""
    out = set()
    n, m = z.shape
    for i in range(n):
        for j in range(m):
            for k, l in ((i + 1, j), (i, j + 1)):
                if k < n and l < m and (z[i, j] >= level) != (z[k, l] >= level):
                    t = (level - z[i, j]) / (z[k, l] - z[i, j])
                    out.add((round(gx[i] + t * (gx[k] - gx[i]), 9), round(gy[j] + t * (gy[l] - gy[j]), 9)))
    return out


def test_fast_poisson_ends_where_poisson_does():
    rng = np.random.default_rng(1)
    T = np.abs(rng.normal(0, 1, (10, 64))) ** 3
    T /= T.max(1, keepdims=True)
    Y = rng.poisson(rng.lognormal(4, 2, (1500, 10)) * (rng.random((1500, 10)) < 0.3) @ T + 5).astype(float)
    Y[0] = 0
    start = Y @ kernels.wls(T, 1 / np.maximum(Y.mean(0), 1e-6)).T
    x = np.where(Y <= 0, 1e-6, Y)

    def deviance(u):
        mu = np.maximum(u @ T, 1e-300)
        return 2 * (x * np.log(x / mu) - x + mu).sum(1)

    plain, fast = kernels.poisson(Y, T, start), kernels.poisson_fast(Y, T, start)
    rise = (deviance(fast) - deviance(plain)) / (deviance(plain) + 0.1)
    assert np.quantile(rise, 0.99) < 1e-5 and rise.max() < 0.05
    assert np.allclose(kernels.poisson_fast(Y[7:8], T, start[7:8]), fast[7:8])  # batches don't matter
    assert np.allclose(kernels.poisson_fast(Y, T, start, iterations=0), np.where(start <= 0, 1e-6, start))
    assert kernels.poisson_fast(Y[:0], T, start[:0]).shape == (0, 10)


def test_contours_meet_every_crossed_edge_once():
    rng = np.random.default_rng(3)
    gx, gy = np.cumsum(rng.random(14) + 0.2), np.cumsum(rng.random(11) + 0.2)
    for k in range(20):
        z = rng.random((14, 11)) if k % 2 else np.exp(-((gx[:, None] - gx.mean()) ** 2 + (gy - gy.mean()) ** 2) / (0.5 + k))
        level = float(rng.uniform(0.2, 0.9)) * z.max()
        found = contours.lines(gx, gy, z, level)
        points = [tuple(p) for line in found for p in (line[:-1] if len(line) > 2 and (line[0] == line[-1]).all() else line)]
        assert len(points) == len({(round(x, 9), round(y, 9)) for x, y in points}) or k % 2 == 0
        assert {(round(x, 9), round(y, 9)) for x, y in points} == crossings(gx, gy, z, level)
        for line in found:  # open lines end at the border
            if not (line[0] == line[-1]).all():
                for x, y in (line[0], line[-1]):
                    assert min(abs(x - gx[0]), abs(x - gx[-1]), abs(y - gy[0]), abs(y - gy[-1])) < 1e-9
    g = np.linspace(-3, 3, 121)
    z = np.exp(-0.5 * (g[:, None] ** 2 + g**2)) + 0.5 * np.exp(-20 * ((g[:, None] - 2.5) ** 2 + (g - 2.5) ** 2))
    ring = contours.longest(g, g, z, np.exp(-0.5))
    assert np.allclose(np.hypot(*ring.T), 1, atol=0.01) and (ring[0] == ring[-1]).all()
    assert len(contours.longest(g, g, z, 9.0)) == 0
    assert np.allclose(np.hypot(*np.array(gate.density_hull(z, g, g, 0.5)).T), np.sqrt(2 * np.log(2)), atol=0.05)


def test_saddles_are_cut_by_their_mean():
    g = np.arange(2.0)

    def sides(corner):  # which edges each piece joins: by the coordinate that lies on the border
        return {frozenset("bottom" if y == 0 else "top" if y == 1 else "left" if x == 0 else "right" for (_, (x, y)) in piece) for piece in contours.segments(g, g, np.array([[1.0, 0.0], [0.0, corner]]), 0.5)}

    assert sides(1.0) == {frozenset(("bottom", "right")), frozenset(("top", "left"))}  # the high corners are joined
    assert sides(0.6) == {frozenset(("bottom", "left")), frozenset(("top", "right"))}


def test_gate_geometry():
    pts = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])
    assert set(gate.hull(pts)) == {(0, 0), (4, 0), (4, 4), (0, 4)}
    z = np.zeros((9, 9))
    z[2, 2], z[2, 3], z[6, 6] = 5, 4, 1
    assert gate.local_maxima(z)[0] == (2, 2) and (6, 6) in gate.local_maxima(z)
    assert gate.mass_threshold(z, 0.9) == 4
    g = np.arange(9.0)
    gate.check_polygon("g", {"x": [1, 2, 3], "y": [1, 2, 1]}, 5, 5)
    for bad in ({"x": [1]}, {"x": [1, 2], "y": [1, 2]}, {"x": [1, 2, 9], "y": [1, 2, 3]}):
        with pytest.raises(ValueError):
            gate.check_polygon("g", bad, 5, 5)


def test_background_removal():
    from lumenfold.operators import af_removal

    rng = np.random.default_rng(8)
    af = np.array([0.1, 0.2, 1.0, 0.7, 0.2, 0.1])
    dye = np.array([1.0, 0.4, 0.1, 0.0, 0.0, 0.0])
    N = rng.normal(0, 5, (3000, 6))
    N[2000:] += rng.lognormal(6.5, 0.4, 1000)[:, None] * af
    X = rng.normal(0, 5, (3000, 6))
    X[1000:2000] += rng.lognormal(7, 0.5, 1000)[:, None] * dye
    X[2000:] += rng.lognormal(6.5, 0.4, 1000)[:, None] * af
    keep = af_removal.keep_mask(X, N, 0)
    assert keep[:1000].mean() > 0.95 and keep[1000:2000].mean() > 0.9 and keep[2000:].mean() < 0.3
    assert af_removal.keep_mask(X[:5], N, 0).all()
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert af_removal.inside(np.array([(2, 2), (0, 2), (4, 4), (5, 1)], float), square).tolist() == [True, True, True, False]


def test_divergent_fits_are_balanced():
    Y = RNG.poisson(X).astype(float)
    start = np.full((len(X), 3), 1e-3)
    fit = kernels.poisson(Y, S, start)
    half = kernels.poisson(Y, S, start, divergence=10.0, handling="Balance", balance=0.5)
    assert np.allclose(half, (fit + start) / 2) and np.allclose(kernels.poisson(Y, S, start, divergence=10.0), start)


def plain_greedy(x, S, library, thresholds, tries):
    """One event, straight from the rules."""
    u = np.linalg.lstsq(S.T, x, rcond=None)[0]
    on = [f for f in range(len(S)) if u[f] >= thresholds[f]]
    if not on:
        return u
    now = S.copy()
    solve = lambda M: np.linalg.lstsq(M[on].T, x, rcond=None)[0]
    start = dict(zip(on, solve(now), strict=True))
    res = x - solve(now) @ now[on]
    error = np.abs(res).sum()
    for f in sorted((f for f in on if f in library), key=lambda f: (-start[f], f)):
        delta = library[f] - S[f]
        score = delta @ res * start[f] / np.linalg.norm(delta, axis=1)
        for v in np.argsort(-score, kind="stable")[:tries]:
            trial = now.copy()
            trial[f] = library[f][v]
            left = x - solve(trial) @ trial[on]
            if np.abs(left).sum() < error:
                now, res, error = trial, left, np.abs(left).sum()
    return np.linalg.lstsq(now.T, x, rcond=None)[0]


def plain_joint(x, y, S, P, library, thresholds, observed, passes, alpha, collinear, weights, floor):
    """One event after its background is gone (x before, y after): the rules of variants chosen jointly, step by step."""
    F, D = S.shape
    w = np.ones(D) if weights is None else 1 / np.maximum(np.abs((P @ y) @ S + (x - y)), floor)
    now = S.copy()
    fit = lambda M: np.linalg.solve((M * w) @ M.T, (M * w) @ y)
    u = fit(now)
    res = y - np.maximum(u, 0) @ now
    current = dict.fromkeys(library, -1)
    pre = {}
    for f, V in library.items():
        rest = np.delete(S, f, axis=0)
        U = np.linalg.solve(rest @ rest.T, rest)
        delta = V - S[f]
        cov = np.cov(observed.get(f, delta), rowvar=False) + 1e-4 * np.eye(D)
        pre[f] = (delta - (delta @ P.T) @ S, (U @ delta.T).T, np.sqrt(np.abs(np.diag(U @ cov @ U.T))) + 1e-8)
    for _ in range(passes):
        accepted = (res**2 * w).sum()
        rss = max(accepted, 1e-12)
        candidates = []
        for f in sorted(library):
            if u[f] < thresholds[f]:
                continue
            across, spread, leak = pre[f]
            other = np.delete(u, f)
            for v in range(len(across)):
                c = current[f]
                d = across[v] - (across[c] if c >= 0 else 0)
                s = spread[v] - (spread[c] if c >= 0 else 0)
                new = rss - 2 * u[f] * (d * res * w).sum() + u[f] ** 2 * (d * d * w).sum()
                if new > 1.1025 * rss:
                    continue
                ratio = (leak * np.abs(other - u[f] * s)).sum() / max((leak * np.abs(other)).sum(), 1e-8)
                score = max(np.sqrt(max(new, 0) / rss), 1e-8) ** alpha * max(ratio, 1e-8) ** (1 - alpha)
                if score < 1:
                    candidates.append((score, f, v))
        if not candidates:
            break
        candidates.sort()
        taken, waits = [], []
        for _, f, v in candidates:
            if any(f == g for g, _, _ in taken):
                continue
            c = current[f]
            d = (pre[f][0][v] - (pre[f][0][c] if c >= 0 else 0)) * u[f]
            clash = [g for g, _, e in taken if abs(d @ e) / (max(np.linalg.norm(d), 1e-12) * max(np.linalg.norm(e), 1e-12)) > 0.5]
            if clash:
                g = clash[0]
                if abs(P[f] @ P[g]) / (np.linalg.norm(P[f]) * np.linalg.norm(P[g]) + 1e-12) > collinear:
                    waits.append((f, v))
                continue
            taken.append((f, v, d))
        for f, v in [t[:2] for t in taken] + waits:
            trial = now.copy()
            trial[f] = library[f][v]
            ut = fit(trial)
            rt = y - np.maximum(ut, 0) @ trial
            if (rt**2 * w).sum() < accepted:
                now, u, res, accepted = trial, ut, rt, (rt**2 * w).sum()
                current[f] = v
        if (res**2).sum() < 1e-16 * (y**2).sum():
            break
    return u


def random_mix(seed, n=150, F=6, D=24, kinds=5, collinear=False):
    rng = np.random.default_rng(seed)
    spectra_ = rng.random((F, D)) + 0.05
    if collinear:
        spectra_[1] = spectra_[0] + 0.15 * rng.random(D)
        spectra_[3] = spectra_[2] + 0.1 * rng.random(D)
    library = {f: spectra_[f] + 0.15 * rng.normal(size=(kinds, D)) * spectra_[f] for f in range(F) if f != 4}
    amounts = rng.lognormal(4, 1, (n, F)) * (rng.random((n, F)) < 0.6)
    X = np.zeros((n, D))
    for f in range(F):
        rows = library[f][rng.integers(0, kinds, n)] if f in library else np.broadcast_to(spectra_[f], (n, D))
        X += amounts[:, f : f + 1] * rows
    return X + rng.normal(0, 2, X.shape), spectra_, library, rng.random((5, D)), rng


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_equals_the_plain_rules(seed):
    Z, spectra_, library, _, rng = random_mix(seed, collinear=bool(seed))
    levels = np.full(len(spectra_), 15.0)
    for tries in (10, 2):
        want = np.array([plain_greedy(x, spectra_, library, levels, tries) for x in Z])
        assert np.allclose(kernels.greedy(Z, spectra_, library, levels, tries), want, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("passes", [1, 3])
def test_joint_equals_the_plain_rules(weighted, passes):
    for seed in (2, 3):
        Z, spectra_, library, background, rng = random_mix(seed, collinear=True)
        Z = Z + 30 * background[rng.integers(0, 5, len(Z))]
        levels = np.full(len(spectra_), 10.0)
        w = 1 / np.maximum(Z.mean(0), 125.0) if weighted else None
        P = kernels.wls_normal(spectra_, np.ones(Z.shape[1]) if w is None else w)
        observed = {0: 0.3 * rng.normal(size=(7, Z.shape[1]))}
        for retry_level in (0.5, 0.1):
            u, amount, index = kernels.joint(Z, spectra_, background, library, levels, w=w, passes=passes, cell_weight=weighted, observed=observed, collinear=retry_level)
            Y = Z - amount[:, None] * background[index]
            want = np.array([plain_joint(x, y, spectra_, P, library, levels, observed, passes, 0.5, retry_level, w, 125.0) for x, y in zip(Z, Y, strict=True)])
            assert np.allclose(u, want, rtol=1e-6, atol=1e-6)
            assert not np.allclose(u, Y @ P.T)


def test_joint_background_passes():
    """Further passes add amounts of events at or above the cutoff while they help; the index stays."""
    Z, spectra_, library, background, rng = random_mix(5)
    Z = Z + 60 * background[rng.integers(0, 5, len(Z))]
    _, one, index = kernels.joint(Z, spectra_, background, {}, np.zeros(6))
    cutoff = float(np.quantile(one, 0.5))
    _, two, again = kernels.joint(Z, spectra_, background, {}, np.zeros(6), again=cutoff, af_passes=3)
    assert (index == again).all() and (two >= one).all() and (two[one < cutoff] == one[one < cutoff]).all() and (two > one).any()


def plain_poisson(y, spectra_, start, iterations=100):
    """One event by the textbook's rules for generalised linear models: identity link, steps halved until all means are positive."""
    y, M = np.where(y <= 0, 1e-6, y), np.abs(spectra_).T
    c = first = np.where(start <= 0, 1e-6, start)
    dev = lambda m: 2 * (y * np.log(y / m) - (y - m)).sum()
    mu, old = M @ c, dev(M @ c)
    for _ in range(iterations):
        r = 1 / np.sqrt(mu)
        new = np.linalg.lstsq(M * r[:, None], y * r, rcond=None)[0]
        for _ in range(iterations):
            if (M @ new > 0).all():
                break
            new = (new + c) / 2
        c, mu = new, M @ new
        if abs(dev(mu) - old) / (abs(dev(mu)) + 0.1) < 1e-8:
            return c
        old = dev(mu)
    return first


def test_poisson_equals_the_plain_rules():
    rng = np.random.default_rng(11)
    amounts = rng.lognormal(2, 1.5, (80, 3)) * (rng.random((80, 3)) < 0.6)
    Y = rng.poisson(amounts @ S).astype(float)
    start = Y @ kernels.ols(S).T
    assert np.allclose(kernels.poisson(Y, S, start), [plain_poisson(y, S, b) for y, b in zip(Y, start, strict=True)], rtol=1e-5, atol=1e-6)
    assert (kernels.poisson(Y, S, start) < 0).any()  # as the model has it
