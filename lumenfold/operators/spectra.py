"""Reference spectra from control samples, similarity, and libraries of background and variation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.arrays import EPS
from lumenfold.functions.ranks import array_quantiles, matrix
from lumenfold.functions.tables import written
from lumenfold.operators import kernels


#: Events of a control that one task may hold as a matrix (51 MB at 64 detectors); larger controls are fitted in rounds.
GROUP = 100_000


def robust_spectra(df: DataFrame, key: str, array_col: str, width: int, fallback_zero: bool = False, group: int = GROUP) -> DataFrame:
    """(key, spectrum): Huber slope of every detector against the sample's peak detector, divided by the largest.

    Controls of up to `group` events are fitted in one task each, all detectors at once; larger ones in rounds of distributed
    sums, whatever their size. A control without spread at its peak has null elements. Without convergence: ordinary least squares, or zero with fallback_zero. Null keys and null
    arrays are left out.
    """
    df = df.where(F.col(key).isNotNull() & F.col(array_col).isNotNull())
    means = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get(array_col, F.lit(i))) for i in range(width)]).alias("mean")).collect()  # a row a control
    peak = {r[key]: int(np.argmax(r["mean"])) for r in means}
    large = sorted(r[key] for r in means if r["n"] > group)
    kind, spark = df.schema[key].dataType.simpleString(), df.sparkSession
    peaks = F.broadcast(spark.createDataFrame([(k, p) for k, p in peak.items() if k not in set(large)], f"{key} {kind}, peak int"))

    def fit(rows: pa.Table) -> pa.Table:
        Y, at = matrix(rows.column("y").combine_chunks(), width), rows.column("peak")[0].as_py()
        slopes, ok = kernels.huber_lines(Y[:, at].copy(), Y)
        return pa.table({key: rows.column(key)[:1], "raw": [np.where(ok | (not fallback_zero), slopes, 0.0)]})

    out = df.join(peaks, key).select(key, "peak", F.col(array_col).alias("y")).groupBy(key).applyInArrow(fit, f"{key} {kind}, raw array<double>")
    if large:
        slopes, ok = robust_rounds(df, key, array_col, width, large, [peak[k] for k in large])
        raw = np.where(ok | (not fallback_zero), slopes, 0.0)
        out = out.unionByName(spark.createDataFrame([(k, r.tolist()) for k, r in zip(large, raw, strict=True)], f"{key} {kind}, raw array<double>"))
    return out.select(key, F.transform("raw", lambda v: F.try_divide(v, F.array_max("raw"))).alias("spectrum"))


def robust_rounds(df: DataFrame, key: str, array_col: str, width: int, keys: list, peaks: list[int], iterations: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, converged), keys x width: huber_line() of every detector against its key's peak, by distributed rounds.

    A round takes the exact scale of the residuals (array_quantiles) and then, in one pass, the weighted sums of each key and
    detector; a few numbers for each pass the driver. Keys leave once all their detectors have converged.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    number = {k: i for i, k in enumerate(keys)}
    numbered = df.join(F.broadcast(spark.createDataFrame(list(number.items()), f"{key} {kind}, _k int")), key).select("_k", F.col(array_col).alias("_y"))
    rows = written(numbered, "robust-rows")
    at = np.array(peaks)
    middle = np.zeros(len(keys))

    def x_of(k, Y):
        return Y[np.arange(len(k)), at[k]] - middle[k]

    def sums(live: list[int], weight=None) -> np.ndarray:
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                every, Z = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), width)
                for k in np.unique(every).tolist():
                    own = every == k
                    Y = Z[own]
                    x = x_of(every[own], Y)[:, None]
                    W = np.ones((len(Y), 1)) if weight is None else weight(k, x, Y)
                    part = np.stack([np.broadcast_to(v.sum(0), width) for v in (W, W * x, W * Y, W * x * x, W * x * Y)])
                    total[k] = total.get(k, 0) + part
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], ["k", "s"])

        got = rows.where(F.col("_k").isin(live)).mapInArrow(run, "k int, s array<double>").groupBy("k").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(5 * width)]).collect()  # a row a key
        out = np.zeros((len(keys), 5, width))
        for r in got:
            out[r["k"]] = np.array(r[1:]).reshape(5, width)
        return out

    first = sums(list(range(len(keys))))
    middle = first[:, 1, 0] / np.maximum(first[:, 0, 0], 1)  # centred: the sums of squares keep their digits
    first = sums(list(range(len(keys))))
    b = np.stack(kernels.two_by_two(*np.moveaxis(first, 1, 0)), 1)
    least = b.copy()
    done = np.zeros((len(keys), width), bool)
    for _ in range(iterations):
        live = np.flatnonzero(~done.all(1)).tolist()
        if not live:
            break

        def residuals(k, Y, b=b, live=np.array(live)):
            k = live[k]
            return np.abs(Y - b[k, 0] - x_of(k, Y)[:, None] * b[k, 1])

        _, q = array_quantiles(rows.where(F.col("_k").isin(live)).withColumnRenamed("_k", "_key"), "_key", "_y", width, [0.5], residuals, live)
        scale = np.zeros((len(keys), width))
        scale[live] = q[:, 0] * 1.4826
        done[live] |= scale[live] < 1e-14

        def weight(k, x, Y, b=b, scale=scale):
            return kernels.huber_weights(Y - b[k, 0] - x * b[k, 1], np.maximum(scale[k], 1e-300))

        new = np.stack(kernels.two_by_two(*np.moveaxis(sums(live, weight), 1, 0)), 1)
        step = np.abs(new - b).max(1) <= tol * np.maximum(1.0, np.abs(b).max(1))
        moving = ~done & np.isin(np.arange(len(keys)), live)[:, None]
        b = np.where(moving[:, None], new, b)
        done |= moving & step
    return np.where(done, b[:, 1], least[:, 1]), done


def cosine_matrix(S: np.ndarray) -> np.ndarray:
    n = np.sqrt((S**2).sum(1) + EPS)
    return (S @ S.T) / np.outer(n, n)


def cosine_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a against rows of b: len(a) x len(b)."""
    na, nb = np.sqrt((a**2).sum(1) + EPS), np.sqrt((b**2).sum(1) + EPS)
    return (a @ b.T) / np.outer(na, nb)


def hotspot_matrix(S: np.ndarray) -> np.ndarray:
    return np.sqrt(np.abs(np.linalg.pinv(cosine_matrix(S))))


def deduplicate(S: np.ndarray, threshold: float = 0.99) -> list[int]:
    """Indices kept in row order: a row stays if its cosine with every kept row is below the threshold."""
    kept: list[int] = []
    for i in range(len(S)):
        if not kept or cosine_cross(S[i : i + 1], S[kept]).max() < threshold:
            kept.append(i)
    return kept


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, -1) + 1
        seen[n] = k
        out.append(n if k == 0 else f"{n}.{k}")
    return out


def scale_abs(S: np.ndarray) -> np.ndarray:
    """Divided by the largest absolute value: inverted spectra stay negative."""
    return S / np.maximum(np.abs(S).max(1, keepdims=True), 1e-300)


def qc_background(af: np.ndarray, dyes: np.ndarray, limit: float = 0.99, remove: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, best cosine, best dye of each row): rows that look like a dye go if asked."""
    c = cosine_cross(af, dyes)
    best = c.max(1)
    return (af[best <= limit] if remove else af), best, c.argmax(1)


def background_library(X: np.ndarray, dyes: np.ndarray, dim: int = 10, dedup: bool = True, refine: bool = True, quantile: float = 0.99, contaminant: float = 0.99, seed: int = 1) -> np.ndarray:
    """Background spectra of unstained events: dye-like events out, map of raw and unmixed values, mean first.

    X is one control sample's events (bounded by what a control holds). Refinement maps the events with the largest
    dye error and adds spectra moved by their typical spill ratio.
    """
    centred = X - X.mean(0)
    dots = np.abs(centred @ dyes.T) / (np.linalg.norm(centred, axis=1)[:, None] * np.linalg.norm(dyes, axis=1) + EPS)
    X = X[(dots < contaminant).all(1)]
    if len(X) < 100:
        raise ValueError("fewer than 100 background events")
    P = kernels.ols(dyes)
    code = kernels.som(np.hstack([X, X @ P.T]), dim, seed=seed)[:, : X.shape[1]]
    af = first_background(X.mean(0), code, dyes, dedup)
    if refine and len(af) >= 2:
        index = kernels.af_by_spill(X, dyes, af)
        u = kernels.with_af(X, dyes, af, index)
        error = X - u @ np.zeros((u.shape[1], X.shape[1])) - u[:, -1:] * af[index]
        size = np.linalg.norm(u[:, :-1], axis=1)
        q, bad = quantile, np.zeros(len(X), dtype=bool)
        while q >= 0.5:
            bad = size >= np.quantile(size, q)
            if bad.sum() >= min(500, len(X) // 2):
                break
            q -= 0.05
        amount = u[bad, -1:]
        ratio = error[bad] / np.where(np.abs(amount) < EPS, 1.0, amount)
        nodes = kernels.som(ratio, max(2, dim // 2), seed=seed)
        of = kernels.nearest(ratio, nodes)
        more = []
        for k in np.unique(of):
            base = af[np.bincount(index[bad][of == k]).argmax()]
            more.append(base + np.median(ratio[of == k], axis=0))
        af = with_novel(af, np.array(more), dyes)
    return af


def first_background(mean: np.ndarray, code: np.ndarray, dyes: np.ndarray, dedup: bool) -> np.ndarray:
    """Mean and codebook scaled, without what looks like a dye or repeats a row."""
    af, _, _ = qc_background(np.vstack([scale_abs(mean[None]), scale_abs(code)]), dyes)
    return af[deduplicate(af)] if dedup and len(af) else af


def with_novel(af: np.ndarray, more: np.ndarray, dyes: np.ndarray) -> np.ndarray:
    """af and those of more, scaled, that look like neither a dye nor a row of af."""
    more, _, _ = qc_background(scale_abs(more), dyes)
    novel = [i for i in range(len(more)) if cosine_cross(more[i : i + 1], af).max() < 0.99]  # one decision a new row
    return np.vstack([af, more[novel]]) if novel else af


def variant_library(X: np.ndarray, negatives: np.ndarray, dye: np.ndarray, dim: int = 5, least_cosine: float = 0.985, least: int = 20, cells: int = 1000, seed: int = 1) -> np.ndarray:
    """Variants of a dye from its control: bright events less the background's directions, like the dye, mapped and scaled.

    Too few events: the reference spectrum alone. Off the peak (reference <= .05) variants go half-way to the reference.
    """
    peak = int(dye.argmax())
    threshold = np.quantile(negatives[:, peak], 0.995) if len(negatives) else -np.inf
    bright = X[X[:, peak] > threshold]
    bright = bright[np.argsort(-bright[:, peak], kind="stable")[: 2 * cells]]
    mean, V = negatives.mean(0) if len(negatives) else 0.0, np.zeros((0, len(dye)))
    if len(negatives) >= 4:
        _, _, vt = np.linalg.svd(negatives - mean, full_matrices=False)
        V = vt[:4]
    return variants_of_bright(bright, mean, V, dye, dim, least_cosine, least, seed)


def variants_of_bright(bright: np.ndarray, mean, V: np.ndarray, dye: np.ndarray, dim: int = 5, least_cosine: float = 0.985, least: int = 20, seed: int = 1) -> np.ndarray:
    """Variants from bright events, given the background's mean and directions."""
    if len(bright) < least:
        return dye[None]
    if len(V):
        away = dye - (dye @ V.T) @ V
        amount = ((bright - mean) @ away) / max(away @ away, EPS)
        back = (bright - amount[:, None] * dye) @ V.T @ V
        bright = bright - back
    bright = bright[np.abs(bright).max(1) > EPS]
    bright = scale_abs(bright)
    bright = bright[cosine_cross(bright, dye[None])[:, 0] >= least_cosine]
    if len(bright) < least:
        return dye[None]
    code = scale_abs(kernels.som(bright, dim, seed=seed))
    off = dye <= 0.05
    code[:, off] = (code[:, off] + dye[off]) / 2
    return np.vstack([dye[None], code])
