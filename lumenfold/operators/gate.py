"""Gates in the scatter plane: polygons, rectangles, density grids, peaks, regions, hulls."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.window import Window

from lumenfold.functions.stats import MAD_SCALE, column_quantiles, is_large
from lumenfold.functions.tables import written
from lumenfold.operators import contours

#: Fixed value: the factor that takes the lower bound in forward scatter out to dead cells.
VIABILITY = 0.67


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Inside, on an edge or on a vertex: ray casting with an exact test of the edges."""
    inside, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        x1, y1, x2, y2 = map(float, (x1, y1, x2, y2))
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on = (cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        edge = edge | on
        if y1 != y2:
            meets = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = (y - y1) * (x2 - x1) / (y2 - y1) + x1
            inside = inside + F.when(meets & (x < at), 1).otherwise(0)
    return edge | (inside % 2 == 1)


def inside(df: DataFrame, x: str, y: str, polygon: list[tuple[float, float]]) -> DataFrame:
    """The events that in_polygon() finds inside. Nulls and what lies beyond the corners go first: without null checks the test
    of a polygon of many edges stays small enough for the JVM to compile."""
    at = F.col(x), F.col(y)
    df = df.where(at[0].isNotNull() & at[1].isNotNull())
    for c, v in zip(at, zip(*polygon, strict=True), strict=True):
        df = df.where(c.between(float(min(v)), float(max(v))))
    return df.where(in_polygon(*at, polygon))


def in_rectangle(x: Column, y: Column, x_lo: float, x_hi: float, y_lo: float, y_hi: float) -> Column:
    return (x > x_lo) & (x < x_hi) & (y > y_lo) & (y < y_hi)


def check_polygon(name: str, gate: dict, x_max: float, y_max: float) -> None:
    """Names x and y, equal lengths, at least three finite vertices inside the axes; else an error."""
    if not {"x", "y"} <= set(gate):
        raise ValueError(f"{name}: x and y are needed")
    x, y = np.asarray(gate["x"], float), np.asarray(gate["y"], float)
    if len(x) != len(y) or len(x) < 3 or not np.isfinite(x).all() or not np.isfinite(y).all():
        raise ValueError(f"{name}: x and y need at least three finite values each")
    if (x < 0).any() or (y < 0).any() or (x > x_max).any() or (y > y_max).any():
        raise ValueError(f"{name}: outside the axes")


def kde(df: DataFrame, x: str, y: str, lo: tuple[float, float], hi: tuple[float, float], n: int, bandwidth: tuple[float, float], bins: int | tuple[int, int] = 512, edges: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, density) on an n x n grid, with a Gaussian kernel.

    Events are counted on a fine grid of cells first (distributed, combined before the shuffle), so the sum runs over at most
    bins^2 cells, not over events. Exact for events at the centres of cells; elsewhere off by less than half a cell.
    The cells span lo to hi, or `edges` on both axes.
    """
    nx, ny = (bins, bins) if isinstance(bins, int) else bins
    first = [lo[a] if edges is None else edges[0] for a in (0, 1)]
    step = [((hi[a] if edges is None else edges[1]) - first[a]) / (nx, ny)[a] for a in (0, 1)]
    cell = [F.floor((F.col(c) - first[a]) / step[a]).cast("int") for a, c in enumerate((x, y))]
    counts = df.groupBy(cell[0].alias("cx"), cell[1].alias("cy")).agg(F.count(F.lit(1)).alias("n")).where(f"cx BETWEEN 0 AND {nx} AND cy BETWEEN 0 AND {ny}")
    rows = np.array([(r["cx"], r["cy"], r["n"]) for r in counts.collect()], dtype=float).reshape(-1, 3)  # at most (bins + 1)^2
    gx, gy = (np.linspace(lo[a], hi[a], n) for a in (0, 1))
    px, py = first[0] + (rows[:, 0] + 0.5) * step[0], first[1] + (rows[:, 1] + 0.5) * step[1]
    kx = np.exp(-0.5 * ((gx[:, None] - px) / bandwidth[0]) ** 2)
    ky = np.exp(-0.5 * ((gy[:, None] - py) / bandwidth[1]) ** 2)
    z = (kx * rows[:, 2]) @ ky.T / (max(rows[:, 2].sum(), 1) * 2 * np.pi * bandwidth[0] * bandwidth[1])
    return df.sparkSession.createDataFrame([(i, j, float(z[i, j])) for i in range(n) for j in range(n)], "i int, j int, density double")


def local_maxima(z: np.ndarray, reach: int = 1) -> list[tuple[int, int]]:
    """Grid cells not below any cell in their neighbourhood, by falling density, ties by position."""
    n, m = z.shape
    out = []
    for i in range(n):
        for j in range(m):
            part = z[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1]
            if z[i, j] > 0 and z[i, j] >= part.max():
                out.append((i, j))
    return sorted(out, key=lambda p: (-z[p], p))


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise, by monotone chains."""
    pts = sorted(set(map(tuple, np.asarray(points, dtype=float))))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


def mass_threshold(z: np.ndarray, share: float) -> float:
    """The density whose cells at or above it hold the given share of the mass most nearly."""
    v = np.sort(z.ravel())[::-1]
    c = np.cumsum(v) / v.sum()
    return float(v[np.abs(c - share).argmin()])


def density_hull(z: np.ndarray, gx: np.ndarray, gy: np.ndarray, share: float = 0.7) -> list[tuple[float, float]]:
    """Hull of the longest contour line at the density above which `share` of the mass lies."""
    return hull(contours.longest(gx, gy, z, mass_threshold(z, share)))


def _settled(x: str, y: str) -> list[Column]:
    """Both axes as doubles without NaN, for quantiles."""
    at = [F.col(c).cast("double") for c in (x, y)]
    return [F.when(~F.isnan(c), c) for c in at]


def spreads(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """Extent, deviation and exact quartiles of both axes, and the number of events: what grids and bandwidths need. One pass for
    the sums, and for the quartiles two on large tables, none on small ones."""
    large = is_large(df)
    sums = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{a}") for a, c in (("x", x), ("y", y)) for k, f in (("min", F.min), ("max", F.max), ("sd", F.stddev_samp))]]
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(_settled(x, y))]
    row = df.agg(*sums, *([] if large else quartiles)).first().asDict()
    found = column_quantiles(df, [], _settled(x, y), [0.25, 0.75], True).first().asDict() if large and row["n"] else row
    out = {k: (0.0 if v is None else float(v)) for k, v in row.items() if k not in ("q0", "q1")}
    for i, a in enumerate("xy"):
        out[f"q1_{a}"], out[f"q3_{a}"] = found.get(f"q{i}") or (0.0, 0.0)
    return out


def normal_reference(s: dict[str, float], factor: float = 1.0, least: float = 0.1) -> tuple[float, float]:
    """Standard deviations of the kernel on both axes by the normal reference rule: 1.06 times the lesser of deviation and
    quartile distance over 1.34, times the fifth root of 1 / n. Where that is nothing, a fourth of `least`."""
    n = max(s["n"], 1.0)
    raw = [1.06 * min(s[f"sd_{a}"], (s[f"q3_{a}"] - s[f"q1_{a}"]) / 1.34) * n**-0.2 for a in "xy"]
    return tuple(factor * (h or least / 4) for h in raw)


def density(df: DataFrame, x: str, y: str, n: int, factor: float = 1.0, bandwidth: tuple[float, float] | None = None, lo=None, hi=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid x, grid y, density) over the events' extent (or lo to hi), with the reference bandwidth (or the given one)."""
    s = spreads(df, x, y)
    if not s["n"]:
        raise ValueError("no event in range")
    lo, hi = lo or (s["min_x"], s["min_y"]), hi or (s["max_x"], s["max_y"])
    hi = tuple(h if h > l else l + 1.0 for l, h in zip(lo, hi, strict=True))  # all in one place
    z = np.zeros((n, n))
    for r in kde(df, x, y, lo, hi, n, bandwidth or normal_reference(s, factor)).collect():
        z[r["i"], r["j"]] = r["density"]
    return np.linspace(lo[0], hi[0], n), np.linspace(lo[1], hi[1], n), z


def outermost(points: np.ndarray) -> np.ndarray:
    """The points that may be corners of the hull: those well inside the hull of the outermost points in sixteen directions are
    left out, all at once."""
    points = points[np.isfinite(points).all(1)]
    if len(points) < 64:
        return points
    low, high = points.min(0), points.max(0)
    unit = (points - low) / np.where(high > low, high - low, 1.0)
    turn = np.arange(16) * np.pi / 8
    ring = np.array(hull(unit[np.unique((unit @ np.stack([np.cos(turn), np.sin(turn)])).argmax(0))]))
    if len(ring) < 3:
        return points
    keep = np.zeros(len(points), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
        keep |= (bx - ax) * (unit[:, 1] - ay) - (by - ay) * (unit[:, 0] - ax) <= 1e-9
    return points[keep]


def _xy(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)


def hull_of_events(df: DataFrame, x: str, y: str, keep=None) -> list[tuple[float, float]]:
    """Convex hull of all events (of those that keep(array of x and y) leaves in the task, if given): tasks send the corners of their own."""

    def corners(batches):
        held = np.empty((0, 2))
        for batch in batches:
            own = _xy(batch)
            own = own if keep is None else own[keep(own)]
            held = np.array(hull(outermost(np.concatenate([held, own]))), dtype=float).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["x", "y"])

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInArrow(corners, "x double, y double").collect()
    return hull(np.array([(r["x"], r["y"]) for r in rows]).reshape(-1, 2))


def cell_density(at: np.ndarray, gx: np.ndarray, gy: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The density at the lower corner of each point's cell of the grid."""
    i, j = (np.clip(np.searchsorted(g, at[:, a], side="right") - 1, 0, len(g) - 2) for a, g in enumerate((gx, gy)))
    return z[i, j]


def dense_hull(df: DataFrame, x: str, y: str, gx: np.ndarray, gy: np.ndarray, z: np.ndarray, threshold: float) -> list[tuple[float, float]]:
    """Hull of the events whose density is more than `threshold` of the way from the least to the greatest among all events: one
    pass for the ends and one for the corners; tasks send two numbers and their own corners, never events."""

    def ends(batches):
        low, high = np.inf, -np.inf
        for batch in batches:
            d = cell_density(_xy(batch), gx, gy, z)
            if len(d):
                low, high = min(low, d.min()), max(high, d.max())
        if low <= high:
            yield pa.RecordBatch.from_arrays([pa.array([float(low)]), pa.array([float(high)])], ["low", "high"])

    at = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    low, high = at.mapInArrow(ends, "low double, high double").agg(F.min("low"), F.max("high")).first()
    limit = (1 - threshold) * low + threshold * high
    return hull_of_events(at, "x", "y", lambda own: cell_density(own, gx, gy, z) > limit)


def enlarged(polygon: list[tuple[float, float]], quantile: float, by: tuple[float, float]) -> list[tuple[float, float]]:
    """For large cells: what lies beyond a quantile of the corners in x is moved out in x, and what lies beyond both in y."""
    c = np.array(polygon)
    edge = np.quantile(c, quantile, axis=0)
    right = c[:, 0] > edge[0]
    up = right & (c[:, 1] > edge[1])
    out = c.copy()
    out[right, 0] += (c[right, 0] - edge[0]) * (by[0] - 1)
    out[up, 1] += (c[up, 1] - edge[1]) * (by[1] - 1)
    return hull(out)


def stretched(polygon: list[tuple[float, float]], by: float, x_max: float, y_max: float) -> list[tuple[float, float]]:
    """Away from the centre by a factor, inside the axes."""
    c = np.mean(polygon, axis=0)
    return [tuple(map(float, np.clip(c + by * (np.array(p) - c), 0, (x_max, y_max)))) for p in polygon]


def find_gate(
    df: DataFrame, x: str, y: str, lo, hi, n: int = 100, threshold: float = 0.05, target: int = 0, exclude=(0.1, 0.05), f_mad: float = 3.0, viability: bool = False, large: tuple[float, tuple[float, float]] | None = None,
    trim: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0), factors: tuple[float, float] = (1.0, 1.0), reach: int = 2,
) -> list[tuple[float, float]]:
    """A cell gate around the events of one density peak.

    Events inside lo to hi, and inside their own extent, give a density with the reference bandwidth (times factors[0]); its
    peaks, the highest first, leave out those in the low corner of the trimmed extent (within `exclude` of both axes) up to
    the first that is not, from which `target` counts. Events nearest to the target among all peaks, within f_mad scaled MADs of
    their median on both axes, give a second density (times factors[1]); the gate is the hull of those whose density is more
    than `threshold` of the way from the least to the greatest. `viability` moves the lower bound in x by 0.67; `large`
    (quantile, factors) moves the upper corners out. Grids, quantiles and corners reach the driver, never events.
    """
    s = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).cast("double").alias(f"{k}_{a}") for a, c in (("x", x), ("y", y)) for k, f in (("min", F.min), ("max", F.max))]).first()
    if not s["n"]:
        raise ValueError("no event in range")
    low, high = (max(lo[0], s["min_x"]), max(lo[1], s["min_y"])), (min(hi[0], s["max_x"]), min(hi[1], s["max_y"]))
    within = df.where(in_rectangle(F.col(x), F.col(y), low[0], high[0], low[1], high[1]))
    gx, gy, z = density(within, x, y, n, factors[0])
    peaks = [(gx[i], gy[j]) for i, j in local_maxima(z, reach)]
    begin = [(1 - trim[2 * a]) * low[a] + trim[2 * a] * high[a] for a in (0, 1)]
    end = [(1 - trim[2 * a + 1]) * low[a] + trim[2 * a + 1] * high[a] for a in (0, 1)]
    first = next((i for i, p in enumerate(peaks) if any((p[a] - begin[a]) / (end[a] - begin[a]) > exclude[a] for a in (0, 1))), None)
    if first is None or first + target >= len(peaks):
        raise ValueError("no density peak in range" if first is None else "no such density peak in range")
    near = nearest_to(within, x, y, peaks, first + target, low, high)
    middle = [q and q[0] for q in column_quantiles(near, [], _settled(x, y), [0.5]).first() or (None, None)]
    if None in middle:
        raise ValueError("no event near the density peak")
    off = near.select(*[F.abs(F.col(c).cast("double") - float(m)).alias(a) for a, c, m in zip("xy", (x, y), middle, strict=True)])
    m = [q[0] for q in column_quantiles(off, [], ["x", "y"], [0.5]).first()]
    reach_of = [f_mad * MAD_SCALE * v for v in m]
    box = [(max(low[a], middle[a] - reach_of[a]), min(high[a], middle[a] + reach_of[a])) for a in (0, 1)]
    if viability:
        box[0] = (box[0][0] * VIABILITY, box[0][1])
    boxed = near.where(in_rectangle(F.col(x), F.col(y), *map(float, (*box[0], *box[1]))))
    gate = dense_hull(boxed, x, y, *density(boxed, x, y, n, factors[1]), threshold)
    if len(gate) < 3:
        raise ValueError("the dense region has no extent")
    return gate if large is None else enlarged(gate, *large)


def pooled_gate(df: DataFrame, x: str, y: str, lo, hi, n: int, share: float, factor: float, bandwidth: tuple[float, float] | None) -> list[tuple[float, float]]:
    inside = df.where(F.col(x).between(lo[0], hi[0]) & F.col(y).between(lo[1], hi[1]))
    gx, gy, z = density(inside, x, y, n, factor, bandwidth)
    return density_hull(z, gx, gy, share)


def landmark_gate(stained: DataFrame, value: str, x: str, y: str, lo, hi, n_events: int = 2000, share: float = 0.7, n: int = 100, sample: str = "sample", id_col: str | list[str] = "event_id", factor: float = 1.0, bandwidth: tuple[float, float] | None = None) -> list[tuple[float, float]]:
    """Where the brightest stained events lie: of the n_events brightest of every control, those inside lo to hi; the hull of the
    longest contour line of their density (reference bandwidth times `factor`, over their extent) that holds `share` of the mass."""
    from lumenfold.operators.clean import top

    best = written(top(stained, value, n_events, [sample], id_col).select(F.col(x).alias("x"), F.col(y).alias("y")), "brightest")  # n_events a control, found once
    return pooled_gate(best, "x", "y", lo, hi, n, share, factor, bandwidth)


def scatter_gate(df: DataFrame, x: str, y: str, share: float = 0.5, n: int = 10, factor: float = 1.0) -> list[tuple[float, float]]:
    """The same of all events, over their extent: where matched events lie."""
    gx, gy, z = density(df, x, y, n, factor)
    return density_hull(z, gx, gy, share)


def tune_gate(df: DataFrame, value: str, x: str, y: str, lo, hi, n_events=(100, 500, 2000), shares=(0.3, 0.5, 0.7), n: int = 100, bandwidth: tuple[float, float] | None = None, ties: list[str] = (), sample: str | None = None, factor: float = 1.0) -> list[tuple[int, float, list[tuple[float, float]]]]:
    """(n_events, share, gate) for a grid of settings of landmark_gate(): n_events brightest events (of every sample, if one is
    named), one density a number, one contour a share."""
    from lumenfold.operators.clean import top

    out = []
    for m in n_events:
        part = written(top(df, value, m, [sample] if sample else [], list(ties)).select(F.col(x).alias("x"), F.col(y).alias("y")), "brightest")
        inside = part.where(F.col("x").between(lo[0], hi[0]) & F.col("y").between(lo[1], hi[1]))
        gx, gy, z = density(inside, "x", "y", n, factor, bandwidth)
        out += [(m, s, density_hull(z, gx, gy, s)) for s in shares]
    return out


def palette(density, low: float, high: float, colours: int = 12) -> Column:
    """Index (from 0) of a density in a palette of equal steps."""
    step = (high - low) / colours
    return F.greatest(F.lit(0), F.least(F.lit(colours - 1), F.floor((density - low) / step).cast("int")))


def rivals(peaks: list[tuple[float, float]], which: int, lo: tuple[float, float], hi: tuple[float, float]) -> list[int]:
    """The peaks that any point of the rectangle may be nearer to than to that one, among those nearer to it than to the rest:
    what bounds its Voronoi cell. The rectangle is cut along the line half way to each peak, the nearest first; a peak counts
    unless it is clearly further off at every corner of what is left."""
    p = np.array(peaks, dtype=float)
    cell = [np.array(c, dtype=float) for c in ((lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1]))]
    ahead = lambda j, v: float(((v - p[j]) ** 2).sum() - ((v - p[which]) ** 2).sum())  # noqa: E731 by how much the peak is nearer than j
    for j in np.argsort((((p - p[which]) / (np.array(hi) - np.array(lo))) ** 2).sum(1), kind="stable"):
        if j != which and cell:
            at, cut = [ahead(j, v) for v in cell], []
            for k, v in enumerate(cell):
                u, du, dv = cell[k - 1], at[k - 1], at[k]
                if (du < 0) != (dv < 0):
                    cut.append(u + (v - u) * (du / (du - dv)))
                if dv >= 0:
                    cut.append(v)
            cell = cut
    margin = 1e-6 * float(((np.array(hi) - np.array(lo)) ** 2).sum())
    return [j for j in range(len(peaks)) if j != which and (not cell or min(ahead(j, v) for v in cell) <= margin)]


def nearest_to(df: DataFrame, x: str, y: str, peaks: list[tuple[float, float]], which: int, lo: tuple[float, float], hi: tuple[float, float]) -> DataFrame:
    """The events, all inside lo to hi, whose nearest peak (lowest of equals) is that one: the rule of voronoi(), asked only of
    the peaks that bound its cell."""
    d = {j: (F.col(x) - float(peaks[j][0])) ** 2 + (F.col(y) - float(peaks[j][1])) ** 2 for j in [which, *rivals(peaks, which, lo, hi)]}
    own = d.pop(which)
    conditions = [own < other if j < which else own <= other for j, other in d.items()]
    return df.where(reduce(and_, conditions)) if conditions else df


def voronoi(df: DataFrame, x: str, y: str, peaks: list[tuple[float, float]]) -> DataFrame:
    """Each event with its nearest peak (index from 0, lowest of equals): expressions over a handful of constants."""
    d = [F.struct(((F.col(x) - float(px)) ** 2 + (F.col(y) - float(py)) ** 2).alias("d"), F.lit(i).alias("i")) for i, (px, py) in enumerate(peaks)]
    return df.withColumn("peak", F.array_min(F.array(*d))["i"])
