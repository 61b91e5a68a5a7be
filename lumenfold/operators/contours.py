"""Contour lines of a density grid, by marching squares."""

from __future__ import annotations

import numpy as np


def segments(gx: np.ndarray, gy: np.ndarray, z: np.ndarray, level: float) -> list[tuple[tuple, tuple]]:
    """Pieces of the line z = level, each across one cell of the grid, between points on the cell's edges (linear along an edge).
    A saddle cell is cut by its mean: corners above the level are joined if the mean is. Equal to the level counts as above."""
    up = z >= level
    out = []

    def cross(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple, tuple[float, float]]:
        """(edge, point) where the line meets the edge between two corners."""
        t = (level - z[a]) / (z[b] - z[a])
        return (min(a, b), max(a, b)), (gx[a[0]] + t * (gx[b[0]] - gx[a[0]]), gy[a[1]] + t * (gy[b[1]] - gy[a[1]]))

    n_up = up[:-1, :-1].astype(int) + up[1:, :-1] + up[1:, 1:] + up[:-1, 1:]
    for i, j in zip(*np.nonzero((n_up > 0) & (n_up < 4)), strict=True):
        ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
        met = [cross(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if up[a] != up[b]]
        if len(met) == 2:
            out.append((met[0], met[1]))
        else:  # all four edges: the first corner stays with its opposite, or is cut off
            joined = (z[ring[0]] + z[ring[1]] + z[ring[2]] + z[ring[3]]) / 4 >= level
            first = up[ring[0]] == joined
            out += [(met[0], met[1]), (met[2], met[3])] if first else [(met[3], met[0]), (met[1], met[2])]
    return out


def lines(gx: np.ndarray, gy: np.ndarray, z: np.ndarray, level: float) -> list[np.ndarray]:
    """The contour lines of a level as arrays of points: closed ones end where they begin, open ones at the grid's border."""
    point, beside = {}, {}
    for (ea, pa), (eb, pb) in segments(gx, gy, z, level):
        point[ea], point[eb] = pa, pb
        beside.setdefault(ea, []).append(eb)
        beside.setdefault(eb, []).append(ea)
    out, used = [], set()

    def walk(start) -> list:
        at, path = start, [start]
        used.add(start)
        while True:
            onward = next((e for e in beside[at] if e not in used), None)
            if onward is None:
                break
            used.add(onward)
            path.append(onward)
            at = onward
        return path

    for start in sorted(beside, key=lambda e: (len(beside[e]) != 1, e)):  # open lines first, from their ends
        if start not in used:
            path = walk(start)
            closed = len(path) > 2 and start in beside[path[-1]]
            out.append(np.array([point[e] for e in path + path[:1] * closed]))
    return out


def longest(gx: np.ndarray, gy: np.ndarray, z: np.ndarray, level: float) -> np.ndarray:
    """The line with the most points, the first of equals; no points where the level is never crossed."""
    return max(lines(gx, gy, z, level), key=len, default=np.empty((0, 2)))
