"""Maps and libraries of controls of any size: events stay distributed, only sums, counts and codebooks meet on the driver.

The same methods as `kernels.som`, `spectra.background_library` and `spectra.variant_library`, which take one matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.stats import quantiles
from lumenfold.operators import kernels, spectra
from lumenfold.operators.spectra import EPS
from lumenfold.operators.unmix import apply_kernel, matrix_of


def total(df: DataFrame, array_col: str, width: int, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all events of a vector of `size` values that f gives for a matrix of events; partial sums by partition."""

    def run(batches):
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += f(matrix_of(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = df.select(array_col).mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("pos", "v"))
    out = np.zeros(size)
    for r in parts.groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r["pos"]] = r["v"]
    return out


def mapped(df: DataFrame, array_col: str, width: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with the array column replaced by f of it, row by row."""
    at, schema = df.columns.index(array_col), df.schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                new = np.ascontiguousarray(f(matrix_of(batch.column(at), width)), dtype=float)
                ends = pa.array(np.arange(len(new) + 1, dtype=np.int32) * new.shape[1])
                columns = [pa.ListArray.from_arrays(ends, pa.array(new.ravel())) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)


def mean(df: DataFrame, array_col: str, width: int) -> tuple[int, np.ndarray]:
    """(events, mean event)."""
    s = total(df, array_col, width, lambda X: np.append(X.sum(0), len(X)), width + 1)
    return int(s[-1]), s[:-1] / max(s[-1], 1)


def som(df: DataFrame, array_col: str, width: int, dim: int, id_col: str, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Batch self-organising map over all events: each epoch is a pass that sums events by nearest node. The first nodes
    are events in hash order of their ids."""
    df = df.select(id_col, array_col).persist()
    try:
        dim = kernels.som_size(df.count(), dim)
        rows = df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(dim * dim).collect()  # as many as nodes
        first = np.array([r[array_col] for r in rows], dtype=float)

        def sums(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def f(X):
                own = (kernels.nearest(X, code)[:, None] == np.arange(len(code))).astype(float)
                return np.concatenate([(own.T @ X).ravel(), own.sum(0)])

            s = total(df, array_col, width, f, len(code) * (width + 1))
            return s[: -len(code)].reshape(code.shape), s[-len(code) :]

        return kernels.som_epochs(first[np.arange(dim * dim) % len(first)], sums, dim, epochs)
    finally:
        df.unpersist()


def background_library(df: DataFrame, array_col: str, dyes: np.ndarray, id_col: str, dim: int = 10, dedup: bool = True, refine: bool = True, quantile: float = 0.99, contaminant: float = 0.99, seed: int = 1) -> np.ndarray:
    """`spectra.background_library` over all events of df."""
    width = dyes.shape[1]
    ev = df.select(id_col, array_col)
    _, centre = mean(ev, array_col, width)

    def clean(X):
        centred = X - centre
        dots = np.abs(centred @ dyes.T) / (np.linalg.norm(centred, axis=1)[:, None] * np.linalg.norm(dyes, axis=1) + EPS)
        return [(dots < contaminant).all(1).astype(float)]

    ev = apply_kernel(ev, array_col, width, clean, [("_clean", "double")], drop=False).where("_clean = 1").drop("_clean")
    n, centre = mean(ev, array_col, width)
    if n < 100:
        raise ValueError("fewer than 100 background events")
    P = kernels.ols(dyes)
    code = som(mapped(ev, array_col, width, lambda X: np.hstack([X, X @ P.T])), array_col, width + len(dyes), dim, id_col, seed=seed)[:, :width]
    af = spectra.first_background(centre, code, dyes, dedup)
    if not refine or len(af) < 2:
        return af

    def fit(X):
        index = kernels.af_by_spill(X, dyes, af)
        u = kernels.with_af(X, dyes, af, index)
        return [index, np.linalg.norm(u[:, :-1], axis=1), u[:, -1]]

    fitted = apply_kernel(ev, array_col, width, fit, [("index", "int"), ("size", "double"), ("amount", "double")], drop=False).persist()
    try:
        q, bad = quantile, fitted.limit(0)
        while q >= 0.5:
            limit = quantiles(fitted, [], "size", q, "limit").first()["limit"]
            bad = fitted.where(F.col("size") >= float(limit))
            if bad.count() >= min(500, n // 2):
                break
            q -= 0.05
        of_row = F.array(*[F.array(*[F.lit(float(v)) for v in a]) for a in af])
        amount = F.when(F.abs("amount") < EPS, 1.0).otherwise(F.col("amount"))
        base = F.element_at(of_row, F.col("index") + 1)
        ratio = F.zip_with(array_col, base, lambda x, a: (x - F.col("amount") * a) / amount)
        moved = bad.select(id_col, "index", ratio.alias("ratio")).persist()
        nodes = som(moved, "ratio", width, max(2, dim // 2), id_col, seed=seed)
        near = apply_kernel(moved, "ratio", width, lambda R: [kernels.nearest(R, nodes)], [("node", "int")], drop=False).persist()
        most = near.groupBy("node", "index").count().groupBy("node").agg(F.max_by("index", F.struct("count", -F.col("index"))).alias("index")).collect()
        medians = quantiles(near.select("node", F.posexplode("ratio").alias("pos", "v")), ["node", "pos"], "v", 0.5, "m").collect()
        middle = np.zeros((len(nodes), width))
        for r in medians:
            middle[r["node"], r["pos"]] = r["m"]
        more = np.array([af[r["index"]] + middle[r["node"]] for r in sorted(most, key=lambda r: r["node"])])
        near.unpersist()
        moved.unpersist()
    finally:
        fitted.unpersist()
    return spectra.with_novel(af, more, dyes)


def background_directions(df: DataFrame, array_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, first four directions of variation) of all events: none of fewer than four events."""
    n, centre = mean(df, array_col, width)
    if n < 4:
        return centre, np.zeros((0, width))

    def scatter(X):
        Z = X - centre
        return (Z.T @ Z).ravel()

    C = total(df, array_col, width, scatter, width * width).reshape(width, width)
    return centre, np.linalg.eigh((C + C.T) / 2)[1][:, ::-1].T[:4]


def variant_libraries(ev: DataFrame, negatives: DataFrame, dyes: dict[int, np.ndarray], label_col: str, array_col: str, id_col: str, cells: int = 1000, least: int = 20, **options) -> dict[int, np.ndarray]:
    """`spectra.variant_library` of each dye from all of its events against all negatives. Of the events above the
    threshold the 2 * cells brightest serve, which is the method's own choice."""
    width = len(next(iter(dyes.values())))
    rows = quantiles(negatives.select(F.posexplode(array_col).alias("pos", "v")), ["pos"], "v", 0.995, "q").collect()
    thresholds = {r["pos"]: r["q"] for r in rows}
    centre, V = background_directions(negatives, array_col, width)
    out = {}
    for name, dye in dyes.items():
        peak = int(dye.argmax())
        at = F.get(array_col, F.lit(peak))
        bright = ev.where((F.col(label_col) == name) & (at > float(thresholds.get(peak, -np.inf)))).orderBy(at.desc(), id_col).limit(2 * cells).select(array_col).collect()
        X = np.array([r[0] for r in bright], dtype=float).reshape(-1, width)
        out[name] = spectra.variants_of_bright(X, centre, V, dye, least=least, **options)
    return out
