"""Removal of background (autofluorescent) events from stained controls.

The region of the background is found on the driver from one unstained control, which keeps to a bounded number of events;
the stained controls' events are filtered where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.biexponential import Biexponential
from lumenfold.operators import gate, kernels
from lumenfold.operators.unmix import matrix_of

MAD = 1.4826


def components(N: np.ndarray, most: int = 10_000, seed: int = 1) -> np.ndarray:
    """Two directions of the negatives' variation: loadings of the median/MAD-scaled events, each scaled to a peak of 1."""
    if len(N) > most:
        N = N[np.random.default_rng(seed).choice(len(N), most, replace=False)]
    mid = np.median(N, axis=0)
    mad = MAD * np.median(np.abs(N - mid), axis=0)
    Z = (N - mid) / np.where(mad < 1e-9, 1.0, mad)
    _, _, vt = np.linalg.svd(Z - Z.mean(0), full_matrices=False)
    C = np.stack([v * np.sign(v[np.abs(v).argmax()]) for v in vt[:2]])
    return C / np.abs(C).max(1, keepdims=True)


def background_box(u: np.ndarray, n: int = 60, target: int = 0) -> tuple[float, float, float, float]:
    """The rectangle around the region nearest the target density peak of two-dimensional points."""
    lo, hi = np.quantile(u, 0.001, axis=0), np.quantile(u, 0.999, axis=0)
    span = np.where(hi - lo < 1e-9, 1.0, hi - lo)
    g = [np.linspace(lo[a], lo[a] + span[a], n) for a in (0, 1)]
    k = [np.exp(-0.5 * ((g[a][:, None] - u[:, a]) / (span[a] / 8)) ** 2) for a in (0, 1)]
    z = k[0] @ k[1].T
    peaks = np.array([(g[0][i], g[1][j]) for i, j in gate.local_maxima(z, 6)])
    near = (((u[:, None] - peaks[None]) / span) ** 2).sum(-1).argmin(1) == min(target, len(peaks) - 1)
    cell = u[near]
    return cell[:, 0].min(), cell[:, 0].max(), cell[:, 1].min(), cell[:, 1].max()


def background_region(x: np.ndarray, y: np.ndarray, clean: np.ndarray, tries: int = 10) -> list[tuple[float, float]]:
    """Hull of the background events along their robust line (within 5 deviations), above the 0.95 quantile of the clean
    events in x, its upper quarter moved out by half. The bound falls by tenths while fewer than ten points are above it;
    without enough points, a triangle of no extent far out."""
    b, m, _ = kernels.huber_line(x, y)
    r = y - (b + m * x)
    sd = max(MAD * np.median(np.abs(r - np.median(r))), 1e-12)
    limit = np.quantile(clean, 0.95) if len(clean) else x.min()
    for _ in range(tries):
        on = (np.abs(r) <= 5 * sd) & (x > limit)
        if on.sum() >= 10:
            break
        limit *= 0.9
    if on.sum() < 3:
        far = float(np.abs(x).max() * 10 + 1)
        return [(far, far), (far + 1e-6, far), (far, far + 1e-6)]
    px, py = x[on], y[on]
    top = px >= np.quantile(px, 0.75)
    out = np.stack([np.append(px, px[top] * 1.5), np.append(py, py[top] * 1.5)], 1)
    return gate.hull(out)


def inside(points: np.ndarray, polygon: list[tuple[float, float]]) -> np.ndarray:
    """Ray casting, edges and vertices inside."""
    x, y = points.T
    odd, edge = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        edge |= (cross == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        if y1 != y2:
            odd ^= ((y1 > y) != (y2 > y)) & (x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)
    return odd | edge


def background_gate(N: np.ndarray, peak: int) -> tuple[int, list[tuple[float, float]]] | None:
    """(detector, polygon over that detector and the peak's) of the background, from the negatives alone; None if they show
    no background apart from their core. peak: the stained dye's detector."""
    if len(N) < 20:
        return None
    P = kernels.ols(components(N))
    u = N @ P.T
    # a linear part as wide as the noise, or the scale would split the main peak
    top, noise = max(float(np.abs(u).max()), 1.0), MAD * np.median(np.abs(u - np.median(u, axis=0)))
    u = Biexponential(top=top, negative=0.5, width=-float(np.clip(20 * noise, 10, 1000)))(u)
    u = u[:, np.argsort(-u.std(0), kind="stable")]
    box = background_box(u)
    core = (u[:, 0] >= box[0]) & (u[:, 0] <= box[1]) & (u[:, 1] >= box[2]) & (u[:, 1] <= box[3])
    if (~core).sum() < 10:
        return None
    spectrum = np.median(N[~core], axis=0) - np.median(N[core], axis=0)
    channel = int(np.abs(spectrum).argmax())
    if channel == peak:  # the detector that separates best, by median difference over deviation
        spread = MAD * np.median(np.abs(N[core] - np.median(N[core], axis=0)), axis=0)
        index = np.abs(spectrum) / np.where(spread < 1e-9, 1.0, spread)
        index[peak] = -np.inf
        channel = int(index.argmax())
    return channel, background_region(N[~core][:, channel], N[~core][:, peak], N[core][:, channel])


def keep_mask(X: np.ndarray, N: np.ndarray, peak: int) -> np.ndarray:
    """Which events of a stained control are not background: N are its negatives, peak its dye's detector."""
    found = background_gate(N, peak) if len(X) >= 20 else None
    return np.ones(len(X), dtype=bool) if found is None else ~inside(X[:, [found[0], peak]], found[1])


def remove_background(events: DataFrame, negatives: np.ndarray, peaks: dict[str, int], sample: str = "sample", array_col: str = "spectral") -> DataFrame:
    """Stained controls without their background events; peaks: the dye's detector by sample. Samples of under 20 events stay
    whole. The polygons come from the negatives (one bounded control) on the driver; events are only filtered, wherever they are."""
    rows = events.where(F.col(sample).isin(list(peaks)))
    few = {r[0] for r in rows.groupBy(sample).count().where("count < 20").collect()}
    gates = {name: None if name in few else background_gate(negatives, at) for name, at in peaks.items()}
    at_sample, at_array = rows.columns.index(sample), rows.columns.index(array_col)

    def run(batches):
        for batch in batches:
            X, names = matrix_of(batch.column(at_array), width), batch.column(at_sample).to_numpy(zero_copy_only=False)
            keep = np.ones(len(X), dtype=bool)
            for name in set(names.tolist()):
                if gates[name] is not None:
                    mine = np.flatnonzero(names == name)
                    keep[mine] = ~inside(X[mine][:, [gates[name][0], peaks[name]]], gates[name][1])
            yield batch.filter(pa.array(keep))

    width = negatives.shape[1]
    return rows.mapInArrow(run, rows.schema)
