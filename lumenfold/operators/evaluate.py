"""How well spectra, background and unmixing do: spill, background accuracy, comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.arrays import peak
from lumenfold.functions.stats import MAD_SCALE, quantiles, with_mad
from lumenfold.operators import kernels, unmix
from lumenfold.operators.clean import top
from lumenfold.operators.events import WIDTH, class_spectra
from lumenfold.operators.knn import knn_join
from lumenfold.operators.unmix import Panel, apply_kernel


def secondary_spill(ev: DataFrame, q: float = 0.99, most: int = 500, width: int = WIDTH) -> DataFrame:
    """(label, pos, spill, ssi) of every dye: positives are strictly above the unstained quantile at the dye's peak, the
    brightest `most`; spill is the median shift relative to the peak's, ssi relative to twice the unstained MAD (0 at the peak)."""
    long0 = ev.where("label = 0").select(F.posexplode("x").alias("pos", "v"))
    neg = quantiles(long0, ["pos"], "v", q, "limit").join(quantiles(long0, ["pos"], "v", 0.5, "med0"), "pos")
    off = long0.join(F.broadcast(neg), "pos").withColumn("off", F.abs(F.col("v") - F.col("med0")))
    mad = quantiles(off, ["pos"], "off", 0.5, "mad").select("pos", (F.lit(MAD_SCALE) * F.col("mad")).alias("mad0"))
    neg = F.broadcast(neg.join(mad, "pos"))  # a row a detector
    peaks = class_spectra(ev.where("label > 0"), width=width).select("label", peak(F.col("spectrum")).alias("peak"))
    at = ev.join(F.broadcast(peaks.join(neg.select(F.col("pos").alias("peak"), "limit"), "peak")), "label").withColumn("at_peak", F.get("x", F.col("peak")))
    pos = top(at.where("at_peak > limit"), "at_peak", most, ["label"], "vec_id")
    shift = pos.select("label", "peak", F.posexplode("x").alias("pos", "v"))
    shift = quantiles(shift, ["label", "peak", "pos"], "v", 0.5, "med")
    shift = shift.join(neg, "pos").withColumn("d", F.col("med") - F.col("med0"))
    target = shift.where("pos = peak").select("label", F.col("d").alias("d_peak"))
    own = F.when(F.col("pos") == F.col("peak"), 0.0).otherwise(F.col("d") / (2 * F.col("mad0")))
    return shift.join(F.broadcast(target), "label").select("label", "pos", (F.col("d") / F.col("d_peak")).alias("spill"), own.alias("ssi"))


def background_accuracy(ev: DataFrame, dyes: Panel, af: Panel, rules=None, array_col: str = "x", id_col: str = "vec_id") -> DataFrame:
    """(rule, mean_cosine, sd_cosine, mean_abs, n): how like its assigned background each unstained event is, and what dye
    signal is left. `baseline` gives every event the mean background. rules: names or functions (X, S, A) by name."""
    rules = rules or unmix.ASSIGNMENTS
    S, A = dyes.S, af.S
    out = None
    for name, fn in {**{n: unmix.ASSIGNMENTS[n] if isinstance(rules, (list, tuple)) else rules[n] for n in rules}, "baseline": lambda X, S, A: np.zeros(len(X), dtype=int)}.items():
        B = A.mean(0, keepdims=True) if name == "baseline" else A

        def run(X, fn=fn, B=B):
            index = fn(X, S, B)
            u = kernels.with_af(X, S, B, index)
            a = B[index]
            c = (X * a).sum(1) / (np.linalg.norm(X, axis=1) * np.linalg.norm(a, axis=1) + 1e-9)
            return [c, np.abs(u[:, :-1]).mean(1)]

        one = apply_kernel(ev.select(id_col, array_col), array_col, S.shape[1], run, [("cosine", "double"), ("left", "double")])
        one = one.agg(F.avg("cosine").alias("mean_cosine"), F.stddev_samp("cosine").alias("sd_cosine"), F.avg("left").alias("mean_abs"), F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(name).alias("rule"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def panel_benchmark(ev: DataFrame, dyes: Panel, af: Panel, sizes, draws: int, seed: int = 42, **options) -> DataFrame:
    """Background accuracy for random panels of several sizes; the panel of (size, draw) has the seed seed + 100 size + draw."""
    out = None
    for n in sizes:
        for d in range(draws):
            keep = sorted(np.random.default_rng(seed + 100 * n + d).choice(len(dyes.S), n, replace=False))
            one = background_accuracy(ev, Panel([dyes.names[i] for i in keep], dyes.S[keep]), af, **options)
            one = one.select(F.lit(n).alias("n_dyes"), F.lit(d).alias("draw"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def compare_backgrounds(ev: DataFrame, dyes: Panel, libraries: dict[str, Panel], rule: str = "fluorophores", array_col: str = "x") -> DataFrame:
    """(library, mean, mad) of the cosine of events with the background assigned from each library."""
    fn, out = unmix.ASSIGNMENTS[rule], None
    for name, af in libraries.items():
        A, S = af.S, dyes.S

        def run(X, A=A, S=S):
            a = A[fn(X, S, A)]
            return [(X * a).sum(1) / (np.linalg.norm(X, axis=1) * np.linalg.norm(a, axis=1) + 1e-9)]

        c = apply_kernel(ev.select(array_col), array_col, S.shape[1], run, [("c", "double")])
        med = quantiles(c, [], "c", 0.5, "m").first()["m"]
        mad = quantiles(c.select(F.abs(F.col("c") - F.lit(med)).alias("c")), [], "c", 0.5, "m").first()["m"]
        one = c.agg(F.avg("c").alias("mean")).select(F.lit(name).alias("library"), "mean", F.lit(None if mad is None else MAD_SCALE * mad).cast("double").alias("mad"))
        out = one if out is None else out.unionByName(one)
    return out


def compare_unmixing(ev: DataFrame, panels: dict[str, Panel], q: float = 0.95, array_col: str = "x") -> DataFrame:
    """(panel, label, pos, spill, ssi) of the same events unmixed with each panel; positions are its dyes."""
    out = None
    for name, p in panels.items():
        cols = [f"u{i}" for i in range(len(p.S))]
        u = unmix.unmix_ols(ev, p, array_col, cols).select("vec_id", "label", F.array(*cols).alias("x"))
        one = secondary_spill(u, q, width=len(cols)).select(F.lit(name).alias("panel"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def scatter_match(test: DataFrame, reference: DataFrame, dyes: Panel, af: Panel | None, axes: list[str], array_col: str = "x", k: int = 5, scale: bool = True, id_col: str = "vec_id") -> DataFrame:
    """Background by scatter: the mean spectrum of the k nearest reference events, optionally its nearest library row by
    cosine, as the background row of each event's own least squares. Adds cosine (clamped to 0..1), AF and the dyes.

    reference: an unstained control's events, all of them, with the same columns; axes are scaled by its mean and MAD if
    asked. Events without scatter, or with no reference at all, have no row.
    """
    S = dyes.S
    width = S.shape[1]
    centre, spread = [0.0] * len(axes), [1.0] * len(axes)
    if scale:
        centre = [v or 0.0 for v in reference.agg(*[F.avg(a) for a in axes]).first()]
        spread = [with_mad(reference, [], a).first()["mad"] or 0.0 for a in axes]
        spread = [v if v >= 1e-9 else 1.0 for v in spread]

    def placed(df):
        return df.select(F.col(id_col), *[((F.col(a).cast("double") - c) / m).alias(f"_a{i}") for i, (a, c, m) in enumerate(zip(axes, centre, spread, strict=True))])

    near = knn_join(placed(test), placed(reference), k, id_col, id_col, [f"_a{i}" for i in range(len(axes))])
    spectra = near.join(reference.select(F.col(id_col).alias("ref_id"), F.col(array_col).alias("_r")), "ref_id")
    mean = class_spectra(spectra, id_col, "_r", width).withColumnRenamed("spectrum", "_mean")
    A = None if af is None else af.S
    P = kernels.ols(S)

    def run(M):
        mean, X = M[:, :width], M[:, width:]
        if A is not None:
            mean = A[((mean @ A.T) / (np.linalg.norm(A, axis=1) + 1e-9)).argmax(1)]
        c = np.clip((X * mean).sum(1) / (np.linalg.norm(X, axis=1) * np.linalg.norm(mean, axis=1) + 1e-9), 0, 1)
        a = mean / np.maximum(np.abs(mean).max(1, keepdims=True), 1e-300)
        r = a - (a @ P.T) @ S
        amount = (X * r).sum(1) / np.maximum((r * r).sum(1), 1e-300)
        u = X @ P.T - amount[:, None] * (a @ P.T)
        return [c, amount, *u.T]

    rows = test.join(mean, id_col).withColumn("_m", F.concat("_mean", array_col)).drop(array_col, "_mean")
    fields = [("cosine", "double"), ("AF", "double"), *[(f"u{i}", "double") for i in range(len(S))]]
    return apply_kernel(rows, "_m", 2 * width, run, fields)
