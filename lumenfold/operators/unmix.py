"""Unmixing of event tables against small matrices of spectra: literals in generated code, or Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.arrays import dot_literal
from lumenfold.functions.stats import quantiles
from lumenfold.operators import kernels

#: Up to so many constants a matrix is inlined as literals; beyond, it goes to a kernel (640 constants: twelve times faster there).
MOST_LITERALS = 100


class Panel:
    """Named spectra in one detector order. Built on the driver: at most a few hundred rows."""

    def __init__(self, names: list, spectra: np.ndarray, detectors: list[str] | None = None):
        self.names, self.S, self.detectors = list(names), np.asarray(spectra, dtype=float), detectors

    @classmethod
    def collect(cls, df: DataFrame, name_col: str, array_col: str) -> Panel:
        rows = df.select(name_col, array_col).orderBy(name_col).collect()
        return cls([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float))

    def without(self, name) -> Panel:
        """Without the row of that name (the background row, before per-event background is added)."""
        keep = [i for i, n in enumerate(self.names) if n != name]
        return Panel([self.names[i] for i in keep], self.S[keep], self.detectors)

    def aligned(self, detectors: list[str]) -> Panel:
        """The same spectra in another order of the same detectors; other sets are an error."""
        if self.detectors is None or list(self.detectors) == list(detectors):
            return self
        if sorted(self.detectors) != sorted(detectors):
            raise ValueError(f"detectors differ: {sorted(set(self.detectors) ^ set(detectors))}")
        at = [self.detectors.index(d) for d in detectors]
        return Panel(self.names, self.S[:, at], list(detectors))

    def condition(self) -> float:
        s = np.linalg.svd(self.S, compute_uv=False)
        return round(float(s[0] / s[-1]), 2) if s[-1] > 0 else float("inf")


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """A batch's list column as a dense matrix; null rows are zeros."""
    if column.null_count:
        out = np.zeros((len(column), width))
        ok = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        out[ok] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(float, copy=False)


def apply_kernel(df: DataFrame, array_col: str, width: int, kernel: Callable[[np.ndarray], list], fields: list[tuple[str, str]], drop: bool = True) -> DataFrame:
    """Columns of df and those the kernel computes from the matrix of array_col, batch by batch.

    fields: (name, Spark type) for each array the kernel returns. Rows whose array is null get null results.
    """
    at = df.columns.index(array_col)
    keep = [i for i, c in enumerate(df.columns) if not (drop and c == array_col)]
    kinds = [pa.int32() if t == "int" else pa.float64() for _, t in fields]
    schema = T.StructType([*[df.schema.fields[i] for i in keep], *[T.StructField(n, T.IntegerType() if t == "int" else T.DoubleType()) for n, t in fields]])

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            got = kernel(matrix_of(column, width)) if batch.num_rows else [np.zeros(0)] * len(fields)
            mask = None if not column.null_count else ~column.is_valid().to_numpy(zero_copy_only=False)
            new = [pa.array(np.asarray(g), k, mask=mask) for g, k in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *new], [*[batch.schema.names[i] for i in keep], *[n for n, _ in fields]])

    return df.mapInArrow(run, schema)


def column_mean(df: DataFrame, array_col: str, width: int) -> np.ndarray:
    """Mean of each detector in one pass, as one row."""
    row = df.agg(*[F.avg(F.get(array_col, F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    return np.array([np.nan if v is None else v for v in row], dtype=float)


def project(df: DataFrame, array_col: str, P: np.ndarray, names: list[str], how: str = "auto") -> DataFrame:
    """u = P x as columns in place of the array (which need not travel back from a kernel): literals while the matrix is
    small, else a kernel."""
    if how == "literal" or how == "auto" and P.size <= MOST_LITERALS:
        return df.withColumns({n: dot_literal(F.col(array_col), p) for n, p in zip(names, P, strict=True)}).drop(array_col)
    return apply_kernel(df, array_col, P.shape[1], lambda X: list((X @ P.T).T), [(n, "double") for n in names])


def unmix_ols(df, panel: Panel, array_col="spectral", names=None, how="auto"):
    return project(df, array_col, kernels.ols(panel.S), names or [str(n) for n in panel.names], how)


def unmix_wls(df, panel: Panel, array_col="spectral", weights=None, names=None, how="auto"):
    """Weighted least squares; without weights, 1 / max(|mean|, 1e-6) over all events (computed once a sample)."""
    w = kernels.weights(column_mean(df, array_col, panel.S.shape[1])) if weights is None else np.asarray(weights)
    return project(df, array_col, kernels.wls(panel.S, w), names or [str(n) for n in panel.names], how)


def wls_per_cell_kernel(panel: Panel, floor=1e-6, names=None):
    """(kernel, fields) of the method, for apply_kernel or for rows from anywhere else; so are the others below."""
    S = panel.S
    return lambda X: list(kernels.wls_each(X, S, 1 / np.maximum(np.abs(X), floor)).T), [(str(n), "double") for n in names or panel.names]


def unmix_wls_per_cell(df, panel: Panel, array_col="spectral", **options):
    """Each event weighted by its own values."""
    return apply_kernel(df, array_col, panel.S.shape[1], *wls_per_cell_kernel(panel, **options))


def poisson_kernel(panel: Panel, weights, names=None, iterations=100, solver=kernels.poisson, **options):
    S = panel.S
    P = kernels.wls(S, np.asarray(weights))
    return lambda X: list(solver(X, S, X @ P.T, iterations, **options).T), [(str(n), "double") for n in names or panel.names]


def unmix_poisson(df, panel: Panel, array_col="spectral", weights=None, **options):
    """Poisson fit started from weighted least squares; events that do not converge keep the start. options: see the kernel."""
    w = kernels.weights(column_mean(df, array_col, panel.S.shape[1])) if weights is None else weights
    return apply_kernel(df, array_col, panel.S.shape[1], *poisson_kernel(panel, w, **options))


#: Rules that assign a background row to each event, by name.
ASSIGNMENTS: dict[str, Callable] = {
    "residuals": kernels.af_by_residual,
    "fluorophores": kernels.af_by_spill,
    "joint_cov": kernels.af_by_joint_cov,
}


def assign_af(df, panel: Panel, af: Panel, array_col="spectral", rule: str | Callable = "fluorophores", name="af_index", drop=True):
    """1-based index of each event's background row; `rule` is a name in ASSIGNMENTS or a function (X, S, A)."""
    fn = ASSIGNMENTS[rule] if isinstance(rule, str) else rule
    S, A = panel.S, af.S
    return apply_kernel(df, array_col, S.shape[1], lambda X: [fn(X, S, A) + 1], [(name, "int")], drop)


def assign_variants(df, panel: Panel, dye, variants: np.ndarray, array_col="spectral", by_cosine=False, name="variant"):
    S, f = panel.S, panel.names.index(dye)
    return apply_kernel(df, array_col, S.shape[1], lambda X: [kernels.variants(X, S, f, variants, by_cosine) + 1], [(name, "int")])


def per_cell_af_kernel(panel: Panel, af: Panel, rule="fluorophores", library=None, thresholds=None, tries=10, names=None):
    if len(af.S) < 2:
        raise ValueError("at least two background spectra are needed")
    S, A, fn = panel.S, af.S, ASSIGNMENTS[rule]
    names = [str(n) for n in names or panel.names]

    def run(X):
        index = fn(X, S, A)
        u = kernels.with_af(X, S, A, index)
        if library:
            u[:, :-1] = kernels.greedy(X - u[:, -1:] * A[index], S, library, np.asarray(thresholds), tries)
        return [*u.T, index + 1]

    return run, [*[(n, "double") for n in names], ("AF", "double"), ("AF Index", "int")]


def unmix_per_cell_af(df, panel: Panel, af: Panel, array_col="spectral", **options):
    """Per-event background: assigned row, then least squares with it; optionally variants on what is left."""
    return apply_kernel(df, array_col, panel.S.shape[1], *per_cell_af_kernel(panel, af, **options))


def joint_statistics(df, panel: Panel, af: Panel, array_col="spectral", cell_weight=False, floor=125.0, af_passes=1, af_quantile=0.5) -> dict:
    """What the joint pipeline takes from a whole sample: detector weights, and the amount of background from which further
    passes are made. Options of the method that need no sample are not listed."""
    S, A = panel.S, af.S
    w = 1 / np.maximum(column_mean(df, array_col, S.shape[1]), floor) if cell_weight else None
    again = None
    if af_passes > 1:
        ones = np.ones(S.shape[1]) if w is None else w
        P = kernels.wls_normal(S, ones)
        amounts = apply_kernel(df.select(array_col), array_col, S.shape[1], lambda X: [kernels.joint_background(X, P, S, A, ones)[1]], [("amount", "double")])
        again = quantiles(amounts, [], "amount", af_quantile, "q").first()["q"]
    return {"w": w, "again": again, "cell_weight": cell_weight, "floor": floor, "af_passes": af_passes}


def joint_kernel(panel: Panel, af: Panel, library=None, thresholds=None, recommended=None, names=None, **options):
    S, A = panel.S, af.S
    level = np.full(len(S), np.inf) if thresholds is None else np.asarray(thresholds)

    def run(X):
        u, amount, index = kernels.joint(X, S, A, library or {}, level, recommended, **options)
        return [*u.T, amount, index + 1]

    return run, [*[(str(n), "double") for n in names or panel.names], ("AF", "double"), ("AF Index", "int")]


def unmix_joint(df, panel: Panel, af: Panel, library=None, thresholds=None, array_col="spectral", cell_weight=False, floor=125.0, af_passes=1, af_quantile=0.5, **options):
    """The joint pipeline. Weights and the quantile for further background passes are taken once over all of df, not by batch."""
    known = joint_statistics(df, panel, af, array_col, cell_weight, floor, af_passes, af_quantile)
    return apply_kernel(df, array_col, panel.S.shape[1], *joint_kernel(panel, af, library, thresholds, **known, **options))


#: The fast Poisson method has a solver of its own, and guards against divergence.
GUARDED = {"solver": kernels.poisson_fast, "divergence": 1e4, "handling": "Balance", "balance": 0.5}


def unmix_fast_poisson(df, panel: Panel, array_col="spectral", **options):
    """The same fits by chords, one matrix inversion an event, with a guard against divergence."""
    return unmix_poisson(df, panel, array_col, **GUARDED | options)


METHODS = {"FastPoisson": unmix_fast_poisson, "OLS": unmix_ols, "WLS": unmix_wls, "WLSPerCell": unmix_wls_per_cell, "Poisson": unmix_poisson, "PerCellAF": unmix_per_cell_af, "Joint": unmix_joint}


def event_kernel(method: str, panel: Panel, weights=None, **options):
    """(kernel, fields) of a method by name. WLS and the Poisson methods need a sample's weights, Joint what joint_statistics
    gives."""
    if method in ("OLS", "WLS"):
        P = kernels.ols(panel.S) if method == "OLS" else kernels.wls(panel.S, np.asarray(weights))
        return lambda X: list((X @ P.T).T), [(str(n), "double") for n in panel.names]
    if method in ("Poisson", "FastPoisson"):
        return poisson_kernel(panel, weights, **(GUARDED if method == "FastPoisson" else {}) | options)
    return {"WLSPerCell": wls_per_cell_kernel, "PerCellAF": per_cell_af_kernel, "Joint": joint_kernel}[method](panel, **options)


def unmix(df: DataFrame, method: str, panel: Panel, **options) -> DataFrame:
    """One entry for all methods; missing values of the results become 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    out = METHODS[method](df, panel, **options)
    return out.fillna(0.0, [c for c, t in out.dtypes if t == "double"])
