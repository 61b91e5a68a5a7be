"""Per-batch linear algebra on NumPy arrays. Notation: X (events x D), S (F x D) rows of spectra, P (F x D) so that u = P x.

No function depends on how events fall into batches.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def ols(S: np.ndarray) -> np.ndarray:
    """Pseudo-inverse by singular values, without truncation."""
    return np.linalg.pinv(S.T, rcond=0) if S.size else S


def ols_normal(S: np.ndarray) -> np.ndarray:
    return np.linalg.solve(S @ S.T, S)


def weights(mean: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    return 1.0 / np.maximum(np.abs(mean), floor)


def wls(S: np.ndarray, w: np.ndarray) -> np.ndarray:
    r = np.sqrt(w)
    return np.linalg.pinv((S * r).T, rcond=0) * r


def wls_normal(S: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.linalg.solve((S * w) @ S.T, S * w)


def gram_each(S: np.ndarray, W: np.ndarray) -> np.ndarray:
    """S diag(w) S' of every event's weights w: one matrix product with the pairwise products of spectra."""
    f, g = np.triu_indices(len(S))
    half = W @ (S[f] * S[g]).T
    out = np.empty((len(W), len(S), len(S)))
    out[:, f, g] = half
    out[:, g, f] = half
    return out


def wls_each(X: np.ndarray, S: np.ndarray, W: np.ndarray) -> np.ndarray:
    """Every event with its own detector weights W (events x D)."""
    return np.linalg.solve(gram_each(S, W), ((X * W) @ S.T)[..., None])[..., 0]


#: Events whose matrices are held at a time.
CHUNK = 1000


def _chunked(fn, n: int):
    """Results of fn(slice) for all events, chunk by chunk."""
    parts = [fn(slice(at, min(at + CHUNK, n))) for at in range(0, max(n, 1), CHUNK)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def poisson(X: np.ndarray, S: np.ndarray, start: np.ndarray, iterations: int = 100, tol: float = 1e-8, floor: float = 1e-6, divergence: float | None = None, handling: str = "Keep", balance: float = 0.5) -> np.ndarray:
    """Poisson regression with identity link by iteratively reweighted least squares, all events at once.

    Data and start at or below zero become `floor`, spectra absolute values. A step after which an expected value is not
    positive is halved until all are; coefficients may be negative. Events whose relative change of the deviance does not
    fall below `tol` keep their start. With `divergence`, events whose fit left the start by more than that
    factor of its size are handled: Keep the start, or Balance (our definition: `balance` of the fit, the rest start).
    """
    X, S = np.where(X <= 0, floor, X), np.abs(S)
    first = np.where(start <= 0, floor, start)

    def fit(part):
        x, u = X[part], first[part].copy()
        out, live = u.copy(), np.arange(len(u))
        log_x = x * np.log(x) - x
        deviance = lambda at, mu: 2 * (log_x[at] - x[at] * np.log(mu) + mu).sum(1)
        mu = u @ S
        old = deviance(live, np.maximum(mu, 1e-300))
        for _ in range(iterations):
            if not len(live):
                break
            try:
                new = wls_each(x[live], S, 1.0 / mu)
            except np.linalg.LinAlgError:
                break
            mean = new @ S
            for _ in range(iterations):
                bad = ~(mean > 0).all(1)
                if not bad.any():
                    break
                new[bad] = (new[bad] + u[live[bad]]) / 2
                mean[bad] = new[bad] @ S
            valid = (mean > 0).all(1) & np.isfinite(new).all(1)
            live, new, mean, old = live[valid], new[valid], mean[valid], old[valid]
            now = deviance(live, mean)
            u[live] = new
            ok = np.abs(now - old) < tol * (np.abs(now) + 0.1)
            out[live[ok]] = new[ok]
            live, mu, old = live[~ok], mean[~ok], now[~ok]
        return out

    return guarded(_chunked(fit, len(X)), first, divergence, handling, balance, floor)


def guarded(out: np.ndarray, first: np.ndarray, divergence: float | None, handling: str, balance: float, floor: float) -> np.ndarray:
    """Fits that left their start by more than `divergence` times its size: see poisson()."""
    if divergence is not None:
        off = np.abs(out - first).max(1) > divergence * np.maximum(np.abs(first).max(1), floor)
        out[off] = first[off] if handling == "Keep" else balance * out[off] + (1 - balance) * first[off]
    return out


def poisson_fast(X: np.ndarray, S: np.ndarray, start: np.ndarray, iterations: int = 100, tol: float = 1e-6, floor: float = 1e-6, divergence: float | None = None, handling: str = "Balance", balance: float = 0.5, refresh: int = 8) -> np.ndarray:
    """The same regression by chords: an event's information matrix is inverted once, at its start, and each step is that
    inverse times the score, so a step costs two products with the spectra for all events together.

    A step after which an expected value is not positive, or the deviance rises, is halved until neither is so; an event that
    has taken `refresh` steps gets the matrix of where it is. Ends, kept starts and the guard are those of poisson(), with a
    looser `tol`.
    """
    X, S = np.where(X <= 0, floor, X), np.abs(S)
    first = np.where(start <= 0, floor, start)

    def fit(part):
        x, u = X[part], first[part].copy()
        out = u.copy()
        base = (x * np.log(x) - x).sum(1)
        deviance = lambda at, mu: 2 * (base[at] + (mu - x[at] * np.log(mu)).sum(1))
        live, mu = np.arange(len(u)), np.maximum(u @ S, 1e-300)
        old = deviance(live, mu)
        inverse = np.empty((len(u), len(S), len(S)))
        for k in range(iterations):
            if not len(live):
                break
            if k % refresh == 0:
                try:
                    inverse[live] = np.linalg.inv(gram_each(S, 1.0 / mu))
                except np.linalg.LinAlgError:
                    break
            step = np.matmul(inverse[live], ((x[live] / mu - 1.0) @ S.T)[..., None])[..., 0]
            new, mean, now = u[live] + step, None, np.empty(len(live))
            todo = np.arange(len(live))
            mean = new @ S
            for _ in range(40):
                good = (mean[todo] > 0).all(1)
                now[todo[~good]] = np.inf
                now[todo[good]] = deviance(live[todo[good]], mean[todo[good]])
                todo = todo[now[todo] > old[todo] * (1 + 1e-12) + 1e-12]
                if not len(todo):
                    break
                step[todo] /= 2
                new[todo] = u[live[todo]] + step[todo]
                mean[todo] = new[todo] @ S
            stuck = np.zeros(len(live), bool)
            stuck[todo] = True  # no step lowers the deviance any more
            new[stuck], mean[stuck], now[stuck] = u[live[stuck]], mu[stuck], old[stuck]
            valid = np.isfinite(new).all(1)
            live, new, mean, now, old = live[valid], new[valid], mean[valid], now[valid], old[valid]
            u[live] = new
            done = np.abs(now - old) < tol * (np.abs(now) + 0.1)
            out[live[done]] = new[done]
            live, mu, old = live[~done], mean[~done], now[~done]
        return out

    return guarded(_chunked(fit, len(X)), first, divergence, handling, balance, floor)


def af_by_residual(X: np.ndarray, S: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Index of the background row with the largest projection of the residual; lowest index of equals."""
    R = X - (X @ ols(S).T) @ S
    return (R @ A.T).argmax(1)


def af_by_spill(X: np.ndarray, S: np.ndarray, A: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """Index of the background row that leaves the least absolute abundance: sum |u - k_j v_j|, k_j = x.r_j / |r_j|^2."""
    P = ols(S)
    U, V = X @ P.T, A @ P.T
    R = A - V @ S
    best, score = np.zeros(len(X), dtype=np.int64), np.full(len(X), np.inf)
    for j in range(len(A)):
        k = (X @ R[j]) / (R[j] @ R[j])
        v = V[j] if factor is None else V[j] * factor
        s = np.abs(U - k[:, None] * v).sum(1)
        better = s < score
        best[better], score[better] = j, s[better]
    return best


def spill_weights(P: np.ndarray, A: np.ndarray) -> np.ndarray:
    return np.sqrt(np.abs(np.einsum("fd,de,fe->f", P, np.cov(A, rowvar=False), P)))


def af_by_joint_cov(X: np.ndarray, S: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Least product of weighted spill and residual, both relative to no background; k is clipped at zero."""
    P = ols(S)
    U, V = X @ P.T, A @ P.T
    R = A - V @ S
    w = spill_weights(P, A)
    res0 = X - np.maximum(U, 0) @ S
    base_spill, base_res = (np.abs(U) * w).sum(1) + 1e-6, np.linalg.norm(res0, axis=1) + 1e-6
    best, score = np.zeros(len(X), dtype=np.int64), np.full(len(X), np.inf)
    for j in range(len(A)):
        k = np.maximum((X @ R[j]) / ((R[j] @ R[j]) or EPS), 0)
        s = (np.abs(U - k[:, None] * V[j]) * w).sum(1) / base_spill * (np.linalg.norm(res0 - k[:, None] * R[j], axis=1) / base_res)
        better = s < score
        best[better], score[better] = j, s[better]
    return best


def variants(X: np.ndarray, S: np.ndarray, f: int, V: np.ndarray, by_cosine: bool = False) -> np.ndarray:
    """Index of the best variant of dye f, scored against the other dyes."""
    rest = np.delete(S, f, axis=0)
    factor = None
    if by_cosine:
        norm = np.sqrt((rest**2).sum(1) + 1e-9) * np.sqrt((V[0] ** 2).sum() + 1e-9)
        factor = (rest @ V[0]) / norm
    return af_by_spill(X, rest, V, factor)


def with_af(X: np.ndarray, S: np.ndarray, A: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Events x (F + 1): least squares on [S; a_j] for each event's j, one solve a background row."""
    out = np.zeros((len(X), len(S) + 1))
    for j in np.unique(index):
        at = index == j
        out[at] = X[at] @ ols(np.vstack([S, A[j]])).T
    return out


class Fits:
    """Least squares fits of many events, each with spectra of its own that change a row at a time.

    S: events x F x D; H: inverses of S w S' over the dyes that are on (zero elsewhere); w: weights (events x D) or None.
    Taking out a dye or putting in another row is a rank-one change of H. A dye's place f may differ from event to event.
    """

    def __init__(self, Y: np.ndarray, S: np.ndarray, H: np.ndarray, w: np.ndarray | None = None):
        self.Y, self.w = Y, w
        self.S = np.broadcast_to(S, (len(Y), *S.shape[-2:])).copy()
        self.H = np.broadcast_to(H, (len(Y), *H.shape[-2:])).copy() if H.ndim == 2 else H

    def _weighed(self, at, v: np.ndarray) -> np.ndarray:
        return v if self.w is None else v * (self.w[at] if v.ndim == 2 else self.w[at][:, None])

    def without(self, at: np.ndarray, f) -> np.ndarray:
        """H of the events `at` with dye f left out."""
        h = self.H[at, f]
        own = h[np.arange(len(at)), f]
        return self.H[at] - h[:, :, None] * (h / own[:, None])[:, None, :]

    def coefficients(self, at: np.ndarray) -> np.ndarray:
        b = np.matmul(self.S[at], self._weighed(at, self.Y[at])[..., None])
        return np.matmul(self.H[at], b)[..., 0]

    def replaced(self, at: np.ndarray, f, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new H, is it regular) if dye f of the events `at` had these spectra (events x D)."""
        rest = self.without(at, f)
        own = self._weighed(at, rows)
        c = np.matmul(rest, np.matmul(self.S[at], own[..., None]))[..., 0]
        g = np.matmul(self.S[at], own[..., None])[..., 0]
        size = (rows * own).sum(1)
        left = size - (g * c).sum(1)
        c[np.arange(len(at)), f] = -1.0
        ok = left > 1e-12 * size
        return rest + c[:, :, None] * (c / np.where(ok, left, 1.0)[:, None])[:, None, :], ok


def greedy(X: np.ndarray, S: np.ndarray, library: dict[int, np.ndarray], thresholds: np.ndarray, tries: int = 10) -> np.ndarray:
    """Per event: for dyes above threshold, by falling abundance, the one of the `tries` most promising variants (cosine of
    its difference with the residual) that lowers the L1 residual most, if any does; final fit with all dyes.

    All events at once: a dye's variants are compared by what they leave beside the other dyes, one product for all of them.
    """
    P = ols(S)
    F = len(S)
    outer = S @ S.T

    def fit(part):
        x = X[part]
        U = x @ P.T
        on = U >= thresholds
        m = max(1, int(on.sum(1).max(initial=0)))
        # each event's dyes that are on, in order; the places of those it lacks stay empty
        dyes = np.argsort(~on, axis=1, kind="stable")[:, :m]
        valid = np.take_along_axis(on, dyes, 1)
        both_on = valid[:, :, None] & valid[:, None, :]
        H = np.linalg.inv(np.where(both_on, outer[dyes[:, :, None], dyes[:, None, :]], np.eye(m))) * both_on
        fits = Fits(x, S[dyes] * valid[..., None], H)
        every = np.arange(len(x))
        u = fits.coefficients(every)
        res = x - np.matmul(u[:, None], fits.S)[:, 0]
        err = np.abs(res).sum(1)
        changed = np.zeros(len(x), dtype=bool)
        may = valid & np.isin(dyes, list(library))
        rank = np.argsort(np.where(may, -u, np.inf), axis=1, kind="stable")
        for turn in range(int(may.sum(1).max(initial=0))):
            dye = np.where(may.sum(1) > turn, dyes[every, rank[:, turn]], -1)
            for f in np.unique(dye[dye >= 0]):
                at = np.flatnonzero(dye == f)
                p = rank[at, turn]
                V = library[f]
                delta = V - S[f]
                size = np.linalg.norm(delta, axis=1)
                score = np.where(size > 1e-12, (res[at] @ delta.T) * u[at, p][:, None] / np.maximum(size, 1e-12), -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, :tries]
                rest = fits.without(at, p)
                rows = fits.S[at]
                pick = V[best]
                both = np.concatenate([x[at][:, None], pick], axis=1)
                left = both - np.matmul(np.matmul(np.matmul(both, rows.transpose(0, 2, 1)), rest), rows)
                base, apart = left[:, 0], left[:, 1:]
                k = np.matmul(apart, base[..., None])[..., 0] / np.maximum((apart**2).sum(2), 1e-300)
                after = base[:, None] - k[..., None] * apart
                trial = np.where(np.take_along_axis(size[None], best, 1) > 1e-12, np.abs(after).sum(2), np.inf)
                v = trial.argmin(1)
                better = trial[np.arange(len(at)), v] < err[at]
                at, p, v, row = at[better], p[better], v[better], np.flatnonzero(better)
                if len(at):
                    new, ok = fits.replaced(at, p, pick[row, v])
                    at, p, v, row, new = at[ok], p[ok], v[ok], row[ok], new[ok]
                    fits.H[at], fits.S[at, p] = new, pick[row, v]
                    res[at], err[at], changed[at] = after[row, v], trial[row, v], True
        at = np.flatnonzero(changed)
        if len(at):
            now = np.broadcast_to(S, (len(at), *S.shape)).copy()
            now[np.arange(len(at))[:, None], dyes[at]] = np.where(valid[at][..., None], fits.S[at], S[dyes[at]])
            U[at] = np.linalg.solve(np.matmul(now, now.transpose(0, 2, 1)), np.matmul(now, x[at][..., None]))[..., 0]
        return U

    return _chunked(fit, len(X))


def joint_background(X: np.ndarray, P: np.ndarray, S: np.ndarray, A: np.ndarray, w: np.ndarray):
    """(index, amount >= 0, score) of the best background row: residual ratio times weighted spill ratio. Weights act on the
    amounts (squared on the data, once on the row's own size) and through P; the residuals are compared without them."""
    U, V = X @ P.T, A @ P.T
    R = A - V @ S
    wa = spill_weights(P, A) + 1e-8
    r0 = X - U @ S
    base = np.maximum((r0**2).sum(1), 1e-16)
    spill0 = np.maximum((np.abs(U) * wa).sum(1), 1e-8)
    size, own = np.maximum((R**2 * w).sum(1), EPS), (R**2).sum(1)
    K = np.maximum(X @ (R * w**2).T, 0) / size
    left = np.sqrt(np.maximum(base[:, None] - 2 * K * (r0 @ R.T) + K**2 * own, 0) / base[:, None])
    best, score, amount = np.zeros(len(X), dtype=np.int64), np.full(len(X), np.inf), np.zeros(len(X))
    for j in range(len(A)):
        s = left[:, j] * ((np.abs(U - K[:, j : j + 1] * V[j]) @ wa) / spill0)
        better = s < score
        best[better], score[better], amount[better] = j, s[better], K[better, j]
    return best, amount, score


class Changes:
    """What the variants of the dyes do to a fit; all variants of all active dyes in one numbering, dye by dye."""

    def __init__(self, S, P, library, active, observed, collinear):
        self.active = active
        self.dye = np.concatenate([np.full(len(library[f]), f) for f in active]) if active else np.zeros(0, np.int64)
        self.rows = np.concatenate([library[f] for f in active]) if active else np.zeros((0, S.shape[1]))
        delta = self.rows - S[self.dye]
        self.across = delta - (delta @ P.T) @ S  # what no dye's abundance can follow
        self.across2 = self.across**2
        self.of, self.spread, self.leak = {}, {}, {}
        for f in active:
            self.of[f] = np.flatnonzero(self.dye == f)
            rest = np.delete(S, f, axis=0)
            U = np.linalg.solve(rest @ rest.T, rest)
            d = observed.get(f, delta[self.of[f]])
            cov = (np.cov(d, rowvar=False) if len(d) > 1 else 0.0) + 1e-4 * np.eye(S.shape[1])
            self.spread[f] = delta[self.of[f]] @ U.T
            self.leak[f] = np.sqrt(np.abs(np.einsum("fd,de,fe->f", U, cov, U))) + 1e-8
        norms = np.linalg.norm(P, axis=1)
        self.alike = np.abs((P @ P.T) / (np.outer(norms, norms) + 1e-12)) > collinear
        self.inner = self.across @ self.across.T

    def scores(self, f: int, u: np.ndarray, res: np.ndarray, rss: np.ndarray, weight, current: np.ndarray, alpha: float) -> np.ndarray:
        """Joint score of each variant of dye f for events with that dye; infinite where the residual would grow too far.
        current: the variant in place (in the common numbering), -1 for the dye's own spectrum."""
        own = self.of[f]
        R = self.across[own]
        amount = u[:, f : f + 1]
        other = np.delete(u, f, axis=1)
        cross = (res if weight is None else res * weight) @ R.T
        size = np.broadcast_to(self.inner[own, own], cross.shape) if weight is None else weight @ self.across2[own].T
        spread = np.broadcast_to(self.spread[f], (len(u), *self.spread[f].shape))
        moved = np.flatnonzero(current >= 0)
        if len(moved):
            c = current[moved] - own[0]
            both = self.inner[own][:, current[moved]].T if weight is None else np.matmul(weight[moved] * R[c], R.T)
            size, spread = size.copy(), spread.copy()
            size[moved] += size[moved, c][:, None] - 2 * both
            cross[moved] -= cross[moved, c][:, None]
            spread[moved] -= self.spread[f][c][:, None]
        new = rss[:, None] - 2 * amount * cross + amount**2 * size
        leak = np.abs(other[:, None] - amount[..., None] * spread) @ self.leak[f]
        leak /= np.maximum(np.abs(other) @ self.leak[f], 1e-8)[:, None]
        ratio = np.sqrt(np.maximum(new, 0) / rss[:, None])
        score = np.maximum(ratio, 1e-8) ** alpha * np.maximum(leak, 1e-8) ** (1 - alpha)
        return np.where((new <= 1.1025 * rss[:, None]) & (score < 1), score, np.inf)

    def chosen(self, score: np.ndarray, current: np.ndarray, retry: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per event, from scores of all variants: the variants to commit, in order, and those to try again after them
        (-1 fills). Of each dye the best one; none whose residual change resembles a better one's (cosine over 1/2), but if
        the two dyes are alike it waits."""
        n, m = score.shape
        alive = score.copy()
        took_at = np.full((n, len(self.alike)), np.inf)  # score at which a dye was committed
        waits = np.zeros((n, m), dtype=bool)
        commits = []
        old = np.full((n, m), -1)
        if (current >= 0).any():
            for f in self.active:
                old[:, self.of[f]] = current[:, f : f + 1]
        at = np.flatnonzero(np.isfinite(alive).any(1))
        inner = self.inner
        while len(at):
            a = alive[at].argmin(1)
            s = alive[at, a]
            turn = np.full(n, -1)
            turn[at] = a
            commits.append(turn)
            took_at[at, self.dye[a]] = s
            # cosine of the changes of the residual: differences to the variants in place
            both = inner[a].copy()
            na, nb = np.diag(inner)[a], np.broadcast_to(np.diag(inner), both.shape).copy()
            cb, ca = old[at], old[at, a]
            if (cb >= 0).any():
                i, j = np.nonzero(cb >= 0)
                both[i, j] -= inner[a[i], cb[i, j]]
                nb[i, j] += inner[cb[i, j], cb[i, j]] - 2 * inner[j, cb[i, j]]
                i = np.flatnonzero(ca >= 0)
                c = ca[i]
                both[i] -= inner[c]
                k, j = np.nonzero(cb[i] >= 0)
                both[i[k], j] += inner[c[k], cb[i[k], j]]
                na = na.copy()
                na[i] += inner[c, c] - 2 * inner[a[i], c]
            near = np.abs(both) > 0.5 * np.sqrt(np.maximum(nb, 0)) * np.sqrt(np.maximum(na, 0))[:, None]
            near &= np.isfinite(alive[at]) & (self.dye[None] != self.dye[a][:, None])
            if retry:
                waits[at] |= near & self.alike[self.dye[a]][:, self.dye]
            alive[at] = np.where(near | (self.dye[None] == self.dye[a][:, None]), np.inf, alive[at])
            at = at[np.isfinite(alive[at]).any(1)]
        waits &= score < took_at[:, self.dye]  # what comes after its dye's commit is not looked at
        order = np.argsort(np.where(waits, score, np.inf), axis=1, kind="stable")[:, : int(waits.sum(1).max(initial=0))]
        again = np.where(np.take_along_axis(waits, order, 1), order, -1)
        return np.array(commits).reshape(len(commits), n).T, again


def joint(X, S, A, library, thresholds, recommended=None, w=None, passes=1, cell_weight=False, floor=125.0, alpha=0.5, collinear=0.5, again=None, af_passes=2, observed=None, retry=True):
    """Background, then variants chosen jointly. Returns (events x F abundances, amount of background, its index from 0).

    again: events with at least that amount (a quantile over the whole sample, computed before) get up to af_passes - 1
    further background passes; the index stays the first one. observed: differences from which the leakage weights of a dye
    are taken; its variants' own, if there are none. w: the sample's detector weights; with cell_weight, the final fit has
    weights of each event's own prediction, background included. retry: variants that only clash with a dye alike to theirs
    are tried again after it.
    """
    D = S.shape[1]
    ones = np.ones(D) if w is None else w
    P = wls_normal(S, ones)
    index, amount, _ = joint_background(X, P, S, A, ones)
    amount = amount.copy()
    Y = X - amount[:, None] * A[index]
    if again is not None:
        at = np.flatnonzero(amount >= again)
        for _ in range(af_passes - 1):
            if not len(at):
                break
            j, k, score = joint_background(Y[at], P, S, A, ones)
            good = score < 1
            Y[at[good]] -= k[good, None] * A[j[good]]
            amount[at[good]] += k[good]
            at = at[good]
    active = [f for f in sorted(library) if len(library[f]) and (recommended is None or recommended[f])]
    changes = Changes(S, P, library, active, observed or {}, collinear)
    level = np.array([thresholds[f] for f in range(len(S))], dtype=float)
    fixed = np.linalg.inv(S @ S.T)

    def fit(part):
        y = Y[part]
        n = len(y)
        weight = None
        H = fixed
        if cell_weight:
            weight = 1 / np.maximum(np.abs((y @ P.T) @ S + (X[part] - y)), floor)
            H = np.linalg.inv(gram_each(S, weight))
        if not active:
            return ((y if weight is None else y * weight) @ S.T)[:, None] @ H if H.ndim == 2 else np.matmul(((y * weight) @ S.T)[:, None], H)
        fits = Fits(y, S, H, weight)
        heavy = lambda r, at: (r**2 if weight is None else r**2 * weight[at]).sum(1)
        every = np.arange(n)
        u = fits.coefficients(every)
        res = y - np.matmul(np.maximum(u, 0)[:, None], fits.S)[:, 0]
        accepted = heavy(res, every)
        signal = (y**2).sum(1)
        current = np.full((n, len(S)), -1)
        live = every

        def commit(at, v):
            f = changes.dye[v]
            for g in np.unique(f):
                mine = f == g
                i, row = at[mine], changes.rows[v[mine]]
                new, ok = fits.replaced(i, g, row)
                before_S, before_H = fits.S[i, g].copy(), fits.H[i]
                fits.S[i, g], fits.H[i] = row, new
                c = fits.coefficients(i)
                r = y[i] - np.matmul(np.maximum(c, 0)[:, None], fits.S[i])[:, 0]
                rss = heavy(r, i)
                good = ok & (rss < accepted[i])
                back = i[~good]
                fits.S[back, g], fits.H[back] = before_S[~good], before_H[~good]
                i, v_ = i[good], v[mine][good]
                u[i], res[i], accepted[i], current[i, g] = c[good], r[good], rss[good], v_

        for _ in range(passes):
            if not len(live):
                break
            rss = np.maximum(accepted[live], 1e-12)
            score = np.full((len(live), len(changes.dye)), np.inf)
            for f in active:
                at = np.flatnonzero(u[live, f] >= level[f])
                if len(at):
                    i = live[at]
                    score[np.ix_(at, changes.of[f])] = changes.scores(f, u[i], res[i], rss[at], None if weight is None else weight[i], current[i, f], alpha)
            some = np.isfinite(score).any(1)
            live, score = live[some], score[some]
            commits, waiting = changes.chosen(score, current[live], retry)
            for turns in (commits, waiting):
                for t in range(turns.shape[1]):
                    at = np.flatnonzero(turns[:, t] >= 0)
                    commit(live[at], turns[at, t])
            live = live[(res[live] ** 2).sum(1) >= 1e-16 * signal[live]]
        return u

    U = _chunked(lambda part: fit(part).reshape(-1, len(S)), len(X))
    return U, amount, index


def necessity(S: np.ndarray, deltas: dict[int, np.ndarray], mu: np.ndarray | None = None, ridge: float = 1e-4) -> np.ndarray:
    """How much each dye's variation disturbs the others, relative to the greatest."""
    out = np.zeros(len(S))
    for f, d in deltas.items():
        if len(d) < 2:
            continue
        U = np.linalg.pinv(np.delete(S, f, axis=0).T)
        cov = np.cov(d, rowvar=False) + ridge * np.eye(S.shape[1])
        out[f] = np.sqrt(np.abs(np.einsum("fd,de,fe->f", U, cov, U))).sum() * (1 if mu is None else mu[f])
    return out / out.max() if out.max() > 0 else out


def huber_line(x: np.ndarray, y: np.ndarray, iterations: int = 100, k: float = 1.345, tol: float = 1e-10) -> tuple[float, float, bool]:
    """(intercept, slope, converged) of y ~ 1 + x by Huber's weights; the scale is the MAD of the residuals."""
    M = np.stack([np.ones_like(x), x], 1)
    b = np.linalg.lstsq(M, y, rcond=None)[0]
    for _ in range(iterations):
        r = y - M @ b
        s = np.median(np.abs(r)) * 1.4826
        if s < 1e-14:
            return float(b[0]), float(b[1]), True
        w = np.minimum(1.0, k / np.maximum(np.abs(r / s), 1e-300))
        new = np.linalg.lstsq(M * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.abs(new - b).max() <= tol * max(1.0, np.abs(b).max()):
            return float(new[0]), float(new[1]), True
        b = new
    b = np.linalg.lstsq(M, y, rcond=None)[0]
    return float(b[0]), float(b[1]), False


def two_by_two(w, wx, wy, wxx, wxy):
    """(intercept, slope) of weighted least squares from its sums; slope 0 where x has no spread."""
    det = w * wxx - wx * wx
    flat = det <= 1e-12 * np.maximum(w * wxx, 1e-300)
    slope = np.where(flat, 0.0, (w * wxy - wx * wy) / np.where(flat, 1.0, det))
    return (wy - slope * wx) / np.maximum(w, 1e-300), slope


def huber_weights(r: np.ndarray, scale: np.ndarray, k: float = 1.345) -> np.ndarray:
    return np.minimum(1.0, k * scale / np.maximum(np.abs(r), 1e-300))


def huber_lines(x: np.ndarray, Y: np.ndarray, iterations: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, converged) of every column of Y against x: huber_line() for all columns at once; columns leave as they converge."""
    n, width = Y.shape
    x = x - x.mean() if n else x

    def fit(W, Y):
        return two_by_two(W.sum(0), (W * x[:, None]).sum(0), (W * Y).sum(0), (W * (x * x)[:, None]).sum(0), (W * x[:, None] * Y).sum(0))

    if n < 2 or np.ptp(x) == 0:
        return np.zeros(width), np.ones(width, bool)
    first = np.stack(fit(np.ones((n, 1)), Y))
    b, done = first.copy(), np.zeros(width, bool)
    for _ in range(iterations):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        r = Y[:, live] - b[0, live] - x[:, None] * b[1, live]
        s = np.median(np.abs(r), axis=0) * 1.4826
        done[live[s < 1e-14]] = True
        live, r, s = live[s >= 1e-14], r[:, s >= 1e-14], s[s >= 1e-14]
        new = np.stack(fit(huber_weights(r, s), Y[:, live]))
        step = np.abs(new - b[:, live]).max(0) <= tol * np.maximum(1.0, np.abs(b[:, live]).max(0))
        b[:, live] = new
        done[live[step]] = True
    return np.where(done, b[1], first[1]), done


def som(X: np.ndarray, dim: int, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Batch self-organising map: dim x dim codebook, Gaussian neighbourhood that shrinks to one node."""
    n, dim = len(X), som_size(len(X), dim)
    code = X[np.random.default_rng(seed).choice(n, dim * dim, replace=n < dim * dim)].astype(float)

    def sums(code):
        node, out = nearest(X, code), np.zeros_like(code)
        np.add.at(out, node, X)
        return out, np.bincount(node, minlength=len(code)).astype(float)

    return som_epochs(code, sums, dim, epochs)


def som_size(n: int, dim: int) -> int:
    """Nodes a side of the map of n events: few events, a smaller map."""
    return min(dim, max(2, int(np.sqrt(n / 3)))) if n < 500 else dim


def som_epochs(code: np.ndarray, sums, dim: int, epochs: int) -> np.ndarray:
    """The codebook after so many passes; sums: sum and count of the events nearest to each node of a codebook."""
    grid = np.stack(np.meshgrid(np.arange(dim), np.arange(dim), indexing="ij"), -1).reshape(-1, 2).astype(float)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(-1)
    for e in range(epochs):
        sigma = max(dim / 2 * (1 - e / epochs), 0.3)
        added, count = sums(code)
        h = np.exp(-apart / (2 * sigma**2))
        total = h @ count
        code = np.where(total[:, None] > 1e-12, (h @ added) / np.maximum(total, 1e-12)[:, None], code)
    return code


def nearest(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    d = (C**2).sum(1)[None] - 2 * X @ C.T
    return d.argmin(1)
