"""Whole workflows: controls to spectra, samples to unmixed files."""

from __future__ import annotations

import os
import re
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.arrays import cosine_rows, peak
from lumenfold.functions.ranks import array_quantiles
from lumenfold.functions.stats import quantiles
from lumenfold.functions.tables import written
from lumenfold.operators import af_removal, clean, control, gate, kernels, spectra, unmix
from lumenfold.operators.events import class_medians, class_spectra
from lumenfold.operators.knn import knn_join
from lumenfold.operators.unmix import Panel
from lumenfold.params import Parameters
from lumenfold.sources import fcs
from lumenfold.sources.spectra_files import carried_channels, define_keywords


@dataclass(frozen=True)
class FlowControl:
    """An experiment's controls: table, detectors, gates, and the gated events of all of them."""

    table: DataFrame
    detectors: list[str]
    parameters: Parameters
    gates: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    events: DataFrame | None = None


def read_events(spark: SparkSession, path: str, p: Parameters) -> tuple[DataFrame, list[str]]:
    """(sample, event_id, other channels, spectral) of a folder of event files, and the detectors' names."""
    fcs.register(spark)
    df = spark.read.format("fcs").load(path)
    detectors = control.spectral_channels(df.columns[2:], p.non_spectral, p.spectral)
    return fcs.pack(df, detectors), detectors


def gated_events(events: DataFrame, gates: dict[str, list[tuple[float, float]]], p: Parameters, gate_col: str = "gate_name") -> DataFrame:
    """Unsaturated events inside their sample's gate; samples without one keep all."""
    x, y = (F.col(f"`{c}`") for c in p.scatter)
    inside = F.lit(True)
    for name, polygon in gates.items():
        inside = F.when(F.col(gate_col) == name, gate.in_polygon(x, y, polygon)).otherwise(inside)
    return clean.unsaturated(events, "spectral", p.saturation).where(inside)


def define_flow_control(spark: SparkSession, folder: str, table: DataFrame, p: Parameters, strict: bool = True, find: bool = True, failing: str = "raise") -> FlowControl:
    """Validate, assign gates, find them on the samples that define them, and read and gate every control.

    A gate that cannot be found is an error that names its samples; with failing="keep", a warning, and they keep all events.
    """
    table = control.blank_to_null(table)
    control.check(table, strict=strict)
    events, detectors = read_events(spark, folder, p)
    grouped = sample_names(control.gate_groups(table))
    facts = grouped.where("stem IS NOT NULL").select("stem", F.col("file_sample").alias("sample"), "fluorophore", "control_type", "gate_name", F.col("file_negative").alias("negative_sample"))
    events = events.withColumnRenamed("sample", "stem").join(F.broadcast(facts), "stem").drop("stem")
    grouped = grouped.drop("stem", "file_sample", "file_negative")
    gates = {}
    if find:
        kinds = grouped.groupBy("gate_name").agg(*[f.alias(k) for k, f in (("beads", F.every(F.coalesce(F.col("control_type") == "beads", F.lit(False)))), ("dead", F.max("is_viability")), ("large", F.max("large_gate")))])
        for name, beads, dead, large in (tuple(r) for r in kinds.orderBy("gate_name").collect()):  # a few gates
            part = events.where(F.col("gate_name") == name)
            options = {"threshold": p.gate_threshold, "exclude": p.gate_exclude, "trim": p.gate_trim, "n": p.gate_grid, "reach": p.gate_reach}
            options |= {"f_mad": p.gate_mads[beads], "factors": p.gate_bandwidths[beads], "viability": bool(dead), "large": p.large_gate if large else None}
            try:
                gates[name] = gate.find_gate(part, *[f"`{c}`" for c in p.scatter], (0.0, 0.0), (p.scatter_max, p.scatter_max), **options)
            except ValueError as e:
                samples = sorted(r[0] for r in part.select("sample").distinct().collect())
                if failing == "raise":
                    raise ValueError(f"gate {name} cannot be found ({e}); samples: {', '.join(samples)}") from e
                warnings.warn(f"gate {name} cannot be found ({e}): {', '.join(samples)} keep all events", stacklevel=2)
    return FlowControl(grouped, detectors, p, gates, gated_events(events, gates, p))


def sample_names(grouped: DataFrame) -> DataFrame:
    """A gated control table with the file's stem, the name of each row's events (file_sample: the stem, and the gate's name where
    a file is cut by several gates), and that of its negative's, cut by the same gate if there is one (file_negative)."""
    stem = F.regexp_replace("filename", r"(?i)\.fcs$", "")
    gates = F.size(F.collect_set(F.coalesce("gate_name", F.lit(""))).over(Window.partitionBy("filename")))
    t = grouped.withColumn("stem", stem).withColumn("file_sample", F.when(gates > 1, F.format_string("%s [%s]", "stem", "gate_name")).otherwise(F.col("stem")))
    files = t.select(F.col("filename").alias("universal_negative"), "gate_name", "file_sample")
    exact = files.groupBy("universal_negative", "gate_name").agg(F.min("file_sample").alias("_same"))
    loose = files.groupBy("universal_negative").agg(F.min("file_sample").alias("_any"))
    t = t.join(exact, ["universal_negative", "gate_name"], "left").join(loose, "universal_negative", "left")
    return t.withColumn("file_negative", F.coalesce("_same", "_any")).drop("_same", "_any")


def reload_flow_control(spark: SparkSession, folder: str, table: DataFrame, p: Parameters) -> FlowControl:
    """Metadata alone, for unmixing with saved spectra; a warning where detector voltages differ between files."""
    fcs.register(spark)
    files = spark.read.format("fcs_header").load(folder).collect()
    keys = {r["path"]: r["keywords"] for r in files}
    first = next(iter(keys.values()))
    channels = [first[f"$P{i}N"] for i in range(1, int(first["$PAR"]) + 1)]
    detectors = control.spectral_channels(channels, p.non_spectral, p.spectral)
    volts = {path: control.spectral_voltages(k, detectors) for path, k in keys.items()}
    ref = next(iter(volts.values()))
    off = sorted({c for v in volts.values() for c in v if v[c] != ref.get(c)})
    if off:
        warnings.warn(f"detector voltages differ between controls: {', '.join(off)}", stacklevel=2)
    return FlowControl(table, detectors, p)


#: Unstained events that the search for background regions looks at, as that method has it: a hash sample of one control.
BACKGROUND_EVENTS = 10_000
#: Nearest events of the negative that each positive event takes.
NEIGHBOURS = 3


def with_negatives(events: DataFrame, unstained: str = "AF") -> DataFrame:
    """Events with the columns negative_sample and control_type: without a control table's, every stained sample has the
    unstained one, and all are cells."""
    columns = [c.lower() for c in events.columns]
    if "negative_sample" not in columns:
        events = events.withColumn("negative_sample", F.when(F.col("fluorophore") != unstained, F.lit(unstained)))
    return events if "control_type" in columns else events.withColumn("control_type", F.lit("cells"))


def is_bare(name) -> F.Column:
    """Unstained controls by name."""
    return F.coalesce(name.rlike(r"(?i)\bAF\b|negative|unstained"), F.lit(False))


def without_background(events: DataFrame, unstained: str = "AF", seed: int = 1) -> DataFrame:
    """Stained cell samples without the events that lie in the background region of their own negative, if that is a control of
    cells; the others (beads, samples without such a negative, the negatives themselves) as they are."""
    columns, events = events.columns, with_negatives(events, unstained)
    width = _width(events)
    samples = events.groupBy("sample", "negative_sample", "control_type").agg(F.max(F.col("fluorophore")).alias("fluorophore")).collect()  # a row a sample
    cells = {r["sample"] for r in samples if r["control_type"] == "cells"}
    serving = {r["negative_sample"] for r in samples if r["negative_sample"]}
    stained: dict[str, list[str]] = {}
    for r in samples:
        if r["sample"] in cells and r["negative_sample"] in cells and r["sample"] not in serving:
            stained.setdefault(r["negative_sample"], []).append(r["sample"])
    if not stained:
        warnings.warn("no unstained cells: background events stay", stacklevel=2)
        return events.select(*[F.col(f"`{c}`") for c in columns])
    every = [name for names in stained.values() for name in names]
    out = events.where(~F.coalesce(F.col("sample").isin(every), F.lit(False)))
    means = class_spectra(events.where(F.col("sample").isin(every)), "sample", "spectral", width=width)
    peaks = {r["sample"]: r["peak"] for r in means.select("sample", peak(F.col("spectrum")).alias("peak")).collect()}  # a row a sample
    for negative, names in sorted(stained.items()):  # a few negatives
        rows = events.where(F.col("sample").isin(names))
        near = clean.sample_rows(events.where(F.col("sample") == negative), BACKGROUND_EVENTS, "event_id", seed).select("spectral").collect()
        kept = af_removal.remove_background(rows, np.array([r[0] for r in near], dtype=float), {n: peaks[n] for n in names}) if near else rows
        out = out.unionByName(kept)
    return out.select(*[F.col(f"`{c}`") for c in columns])


def clean_controls(events: DataFrame, p: Parameters, unstained: str = "AF", universal: bool = True, seed: int = 1, remove_af: bool = True) -> DataFrame:
    """The events of each control that its spectrum is to be taken from, and their part in it (role).

    Stained cells lose their background events first. Then each stained sample meets its own negative (negative_sample, as
    the control table has it): positive are events above the negative's quantile at the sample's peak (p.positivity;
    p.positivity_af for an unstained sample that has a negative of its own), the brightest p.positive_n of them; negative are
    the events of the negative nearest to them in scatter, each once, as rows of the stained sample. With under
    p.min_cells_stop positives a sample keeps all its events, and its whole negative; with under p.min_cells_stop matched
    negatives, it takes p.negative_n of its negative by hash. Samples without a negative keep all events (role "all"),
    unstained ones too (role "unstained"), of which the one named `unstained` gives p.negative_n by hash.

    Beads never lose background events. Without universal negatives, each stained sample gives its brightest and dimmest events.
    (sample, event_id) names an event; null scatter matches nothing. Fewer than p.min_cells_warning positives, or half as many
    negatives, are a warning.
    """
    columns = events.columns
    events = with_negatives(events, unstained)
    if remove_af and universal:
        events = without_background(events, unstained, seed)
    width = _width(events)
    names = [F.col(f"`{c}`") for c in columns]
    bare = is_bare(F.col("fluorophore"))
    peaks = class_spectra(events, "sample", "spectral", width=width).select("sample", peak(F.col("spectrum")).alias("peak"))
    if not universal:
        at = events.where(~bare).join(F.broadcast(peaks), "sample").withColumn("at_peak", F.get("spectral", F.col("peak")))
        return clean.top_and_bottom(at, "at_peak", p.positive_n, p.negative_n, ["sample"]).select(*names, "role")

    info = events.groupBy("sample", "negative_sample").agg(F.first("fluorophore").alias("fluorophore")).join(peaks, "sample").collect()  # a row a sample
    have = {r["sample"] for r in info}
    pairs = [(r["sample"], r["negative_sample"], r["fluorophore"], r["peak"]) for r in info if r["negative_sample"] in have and r["negative_sample"] != r["sample"]]
    paired = {s for s, *_ in pairs}
    table = F.broadcast(events.sparkSession.createDataFrame(pairs, "_stained string, _negative string, _dye string, _peak int"))
    negatives = events.join(table, F.col("sample") == F.col("_negative"))  # once for each sample that it serves
    shown = negatives.withColumn("_v", F.get("spectral", F.col("_peak")))
    own = is_bare(F.col("_dye"))
    limits = quantiles(shown.where(~own), ["_stained"], "_v", p.positivity, "_limit").unionByName(quantiles(shown.where(own), ["_stained"], "_v", p.positivity_af, "_limit"))
    at = events.join(table, F.col("sample") == F.col("_stained")).withColumn("_v", F.get("spectral", F.col("_peak")))
    above = at.join(F.broadcast(limits), "_stained").where("_v > _limit")  # a row a sample
    n_above = dict.fromkeys(paired, 0) | {r[0]: r[1] for r in above.groupBy("sample").count().collect()}
    few = sorted(s for s, n in n_above.items() if n < p.min_cells_stop)
    low = sorted(s for s, n in n_above.items() if n < p.min_cells_warning)
    if low:
        warnings.warn(f"fewer than {p.min_cells_warning} positive events: {', '.join(low)}" + (f"; with all their events, for fewer than {p.min_cells_stop}: {', '.join(few)}" if few else ""), stacklevel=2)
    bright = written(clean.top(above.where(~F.col("sample").isin(few)), "_v", p.positive_n, ["sample"]).select(*names, "_negative"), "positives")

    axes = [f"`{c}`" for c in p.scatter]
    event = F.struct("sample", "event_id").alias("q")
    near = knn_join(bright.select(event, "_negative", *axes), events.where(F.col("sample").isin(sorted({n for _, n, *_ in pairs}))).select(F.col("sample").alias("_negative"), "event_id", *axes), NEIGHBOURS, "q", "event_id", axes, key="_negative")
    wanted = written(near.select(F.col("q.sample").alias("_stained"), F.col("ref_id").alias("event_id")).distinct(), "matched")
    n_near = dict.fromkeys(paired - set(few), 0) | {r[0]: r[1] for r in wanted.groupBy("_stained").count().collect()}
    unmatched = sorted(s for s, n in n_near.items() if n < p.min_cells_stop)
    low = sorted(s for s, n in n_near.items() if n < -(-p.min_cells_warning // 2))
    if low:
        warnings.warn(f"fewer than {-(-p.min_cells_warning // 2)} negatives near in scatter: {', '.join(low)}" + (f"; with a sample of their negative, for fewer than {p.min_cells_stop}: {', '.join(unmatched)}" if unmatched else ""), stacklevel=2)

    def as_negative(rows: DataFrame) -> DataFrame:
        """Events of negatives as rows of the samples they serve."""
        swapped = {"sample": F.col("_stained"), "fluorophore": F.col("_dye")}
        return rows.select(*[swapped[c].alias(c) if c in swapped else F.col(f"`{c}`") for c in columns], F.lit("negative").alias("role"))

    matched = negatives.where(~F.col("_stained").isin(few + unmatched)).join(wanted, ["_stained", "event_id"], "left_semi")
    turn = Window.partitionBy("_stained").orderBy(F.xxhash64(F.lit(seed), "event_id"), "event_id")
    sampled = negatives.where(F.col("_stained").isin(unmatched)).withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= p.negative_n)
    parts = [
        bright.select(*names, F.lit("positive").alias("role")),
        events.where(F.col("sample").isin(few)).select(*names, F.lit("positive").alias("role")),
        as_negative(matched),
        as_negative(sampled),
        as_negative(negatives.where(F.col("_stained").isin(few))),
        events.where(~F.col("sample").isin(sorted(paired)) & ~bare).select(*names, F.lit("all").alias("role")),
    ]
    rest = events.where(~F.col("sample").isin(sorted(paired)) & bare)
    turn = Window.partitionBy("sample").orderBy(F.xxhash64(F.lit(seed), "event_id"), "event_id")
    rest = rest.withColumn("_n", F.row_number().over(turn)).where((F.col("fluorophore") != unstained) | (F.col("_n") <= p.negative_n))
    parts.append(rest.select(*names, F.lit("unstained").alias("role")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _width(events: DataFrame) -> int:
    row = events.select(F.size("spectral")).first()
    return row[0] if row else 0


def reference_spectra(cleaned: DataFrame, unstained: str = "AF") -> Panel:
    """Robust slope spectra of every dye, and the mean of the unstained as AF."""
    s = spectra.robust_spectra(cleaned, "fluorophore", "spectral", _width(cleaned))
    return Panel.collect(s, "fluorophore", "spectrum")


def whole_single_events(events: DataFrame, p: Parameters, singlets: tuple[float, float] = (0.85, 0.975)) -> DataFrame:
    """Events of files as they come, without saturated ones, those beyond the scatter ceilings, and doublets: by sample, area
    to height must be below its quantile in forward scatter, then among the rest in side scatter. Steps whose channels are
    missing are left out."""
    x, y = p.scatter
    rows = clean.below_ceiling(clean.unsaturated(events, "spectral", p.saturation), f"`{x}`", f"`{y}`", p.scatter_max, p.scatter_max)
    for c, q in zip((x, y), singlets, strict=True):
        height = re.sub("-A$", "-H", c)
        if height == c or height not in rows.columns:
            break
        rows = clean.ratio_filter(rows.withColumns({"_area": F.col(f"`{c}`"), "_height": F.col(f"`{height}`")}), ["sample"], "_area", "_height", q).drop("_area", "_height")
    return rows


#: Of a control without a negative: its brightest events, and the share of its dimmest that stands for one.
INTERNAL_TOP, INTERNAL_SHARE = 100, 0.1


def automated_spectra(
    events: DataFrame, p: Parameters, library: Panel | None = None, unstained: str = "AF", candidates: int = 1000, keep: int = 200, k: int = 2, refine: bool = True, gates: dict[str, list[tuple[float, float]]] | None = None,
) -> tuple[Panel, list[tuple[str, str, float]]]:
    """Spectra straight from controls, and (dye, status, similarity to the library) of each.

    First route, without gates: the peak once the direction of the sample's own background is projected out, the brightest
    candidates at it, of those the least background-like, less the mean of their k nearest events of the negative in scatter;
    column medians, divided by the largest, not negative. A control without a negative takes the mean of its brightest
    events less that of its dimmest.

    Dyes whose similarity is under p.cosine_fail, or whose spectrum has no positive value, are LEGACY_REFINEMENT. With `refine`
    they go the second route together: gated (where `gates` has their gate_name), cleaned against their negatives, robust
    slopes; the spectrum more like the library's is kept (LEGACY_USED, LEGACY_REJECTED), a dye that no library knows
    keeps its first one (LEGACY_REJECTED), and one without any finite spectrum is QC_FAIL. All others are OK.
    """
    if "sample" not in events.columns:
        events = events.withColumn("sample", F.col("fluorophore"))
    events = with_negatives(events, unstained)
    width, spark = _width(events), events.sparkSession
    every = events.groupBy("sample", "negative_sample").agg(F.first("fluorophore").alias("dye"), F.first(is_bare(F.col("fluorophore"))).alias("bare"), F.count(F.lit(1)).alias("n")).collect()  # a row a sample
    have = {r["sample"] for r in every}
    stained = {r["sample"]: r for r in every if not r["bare"]}
    external = {s: r["negative_sample"] for s, r in stained.items() if r["negative_sample"] in have - {s}}
    internal = sorted(stained.keys() - external.keys())
    of = {s: r["dye"] for s, r in stained.items()}
    means = Panel.collect(class_spectra(events.where(F.col("sample").isin(sorted(stained))), "sample", "spectral", width), "sample", "spectrum")
    mean = dict(zip(means.names, means.S, strict=True))
    raw: dict[str, np.ndarray] = {}
    if external:
        raw |= _against_negatives(events, p, external, mean, candidates, keep, k)
    if internal:
        raw |= _against_themselves(events, {s: int(mean[s].argmax()) for s in internal}, {s: stained[s]["n"] for s in internal}, width)

    found = {}
    for sample in sorted(raw, key=lambda s: of[s]):
        top = raw[sample].max()
        found[of[sample]] = np.maximum(raw[sample] / top, 0) if np.isfinite(top) and top > 0 else np.zeros(width)

    def likeness(dye: str, s: np.ndarray) -> float:
        if library is None or dye not in library.names:
            return float("nan")
        return float(spectra.cosine_cross(s[None], library.S[[library.names.index(dye)]])[0, 0])

    log = {}
    for dye, s in found.items():
        c = likeness(dye, s)
        log[dye] = ["LEGACY_REFINEMENT" if c < p.cosine_fail or not s.any() else "OK", c]
    flagged = [dye for dye, (status, _) in log.items() if status != "OK"]
    if refine and flagged:
        samples = [s for s, dye in of.items() if dye in flagged]
        part = events.where(F.col("sample").isin(samples + sorted({external[s] for s in samples if s in external})))
        if gates:
            part = gated_events(part, gates, p)
        cleaned = clean_controls(part, p, unstained).where(F.col("fluorophore").isin(flagged))
        second = Panel.collect(spectra.robust_spectra(cleaned, "fluorophore", "spectral", width), "fluorophore", "spectrum")
        slopes = {dye: s for dye, s in zip(second.names, second.S, strict=True) if np.isfinite(s).all()}
        for dye in flagged:
            first, c = log[dye][1], likeness(dye, slopes[dye]) if dye in slopes else float("nan")
            better = not np.isnan(c) and not c <= first
            if better:
                found[dye] = slopes[dye]
            log[dye] = ["LEGACY_USED" if better else "LEGACY_REJECTED" if dye in slopes or found[dye].any() else "QC_FAIL", c if better else first]
        warnings.warn("low similarity to the library, second route taken: " + ", ".join(f"{d} {log[d][0]}" for d in flagged), stacklevel=2)
    return Panel(list(found), np.array(list(found.values())).reshape(len(found), width)), [(dye, *log[dye]) for dye in found]


def _against_negatives(events: DataFrame, p: Parameters, negative: dict[str, str], mean: dict[str, np.ndarray], candidates: int, keep: int, k: int) -> dict[str, np.ndarray]:
    """Medians of each sample's bright, least background-like events, each less its nearest events of the negative."""
    spark, width = events.sparkSession, len(next(iter(mean.values())))
    negatives = events.where(F.col("sample").isin(sorted(set(negative.values()))))
    middle = Panel.collect(class_medians(negatives, "sample", "spectral", width), "sample", "spectrum")
    background = dict(zip(middle.names, middle.S, strict=True))
    rows = []
    for s, n in negative.items():
        unit = background[n] / max(np.linalg.norm(background[n]), 1e-12)
        rows.append((s, n, int((mean[s] - (mean[s] @ unit) * unit).argmax()), background[n].tolist()))
    facts = F.broadcast(spark.createDataFrame(rows, "sample string, _negative string, _peak int, _background array<double>"))  # a row a sample
    at = events.drop("negative_sample").join(facts, "sample").withColumn("_v", F.get("spectral", F.col("_peak")))
    best = clean.top(at, "_v", candidates, ["sample"]).withColumn("_unlike", -cosine_rows(F.col("spectral"), F.col("_background")))
    axes = [f"`{c}`" for c in p.scatter]
    best = written(clean.top(best, "_unlike", keep, ["sample"]).select(F.struct("sample", "event_id").alias("q"), "_negative", "spectral", *axes), "candidates")
    near = knn_join(best, negatives.select(F.col("sample").alias("_negative"), "event_id", *axes), k, "q", "event_id", axes, key="_negative")
    matched = near.join(best.select("q", "_negative"), "q").join(negatives.select(F.col("sample").alias("_negative"), F.col("event_id").alias("ref_id"), F.col("spectral").alias("_b")), ["_negative", "ref_id"])
    under = class_spectra(matched, "q", "_b", width)
    left = best.join(under, "q", "left")  # events without scatter have no neighbours: nothing is taken off
    left = left.select("q.sample", F.when(F.col("spectrum").isNull(), F.col("spectral")).otherwise(F.zip_with("spectral", "spectrum", lambda a, b: a - b)).alias("x"))
    got = Panel.collect(class_medians(left, "sample", "x", width), "sample", "spectrum")
    return dict(zip(got.names, got.S, strict=True))


def _against_themselves(events: DataFrame, peaks: dict[str, int], n: dict[str, int], width: int) -> dict[str, np.ndarray]:
    """Mean of each sample's brightest events less that of its dimmest tenth (at least two; equal values at its edge count)."""
    spark = events.sparkSession
    facts = F.broadcast(spark.createDataFrame(list(peaks.items()), "sample string, _peak int"))
    at = events.join(facts, "sample").select("sample", "event_id", "spectral", F.get("spectral", F.col("_peak")).alias("_v"))
    high = class_spectra(clean.top(at, "_v", INTERNAL_TOP, ["sample"]), "sample", "spectral", width)
    edges = []
    for s in peaks:  # a few controls, one value each
        last = min(n[s], max(2, int(n[s] * INTERNAL_SHARE))) - 1
        _, q = array_quantiles(at.where(F.col("sample") == s).select("sample", F.array("_v").alias("v")), "sample", "v", 1, [last / max(1, n[s] - 1)])
        edges.append((s, float(q[0, 0, 0])))
    edge = F.broadcast(spark.createDataFrame(edges, "sample string, _edge double"))
    low = class_spectra(at.join(edge, "sample").where(F.col("_v") <= F.col("_edge") + F.abs("_edge") * 1e-12), "sample", "spectral", width)
    got = [Panel.collect(df, "sample", "spectrum") for df in (high, low)]
    below = dict(zip(got[1].names, got[1].S, strict=True))
    return {s: np.maximum(v - below[s], 0) for s, v in zip(got[0].names, got[0].S, strict=True)}


def checked(p: Panel, method: str, af: Panel | None) -> Panel:
    """The dyes a method fits: without the background row, if it finds each event's own. Warns of an ill-conditioned panel."""
    if method in ("PerCellAF", "Joint"):
        if af is None or len(af.S) < 2:
            raise ValueError(f"{method} needs at least two background spectra")
        p = p.without("AF")
    if p.condition() > len(p.names):
        warnings.warn(f"condition number {p.condition()} exceeds the number of dyes", stacklevel=3)
    return p


def unmix_events(events: DataFrame, p: Panel, method: str = "OLS", af: Panel | None = None, **options) -> DataFrame:
    """Events unmixed by a named method; dye columns get the suffix -A, the background index does not."""
    p = checked(p, method, af)
    if method in ("PerCellAF", "Joint"):
        options = {**options, "af": af}
    out = unmix.unmix(events, method, p, array_col="spectral", **options)
    names = {str(n): f"{n}-A" for n in p.names} | {"AF": "AF-A"}
    return out.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns if c != "spectral"])


#: Events of a file that a task handles, at most; its kernel takes a tenth at a time.
TASK_EVENTS = 100_000


def unmix_file(spark: SparkSession, path: str, out: str, p: Panel, parameters: Parameters, method: str = "OLS", af: Panel | None = None, raw: bool = False, weight_events: int | None = 100_000, **options) -> str:
    """One event file to one unmixed file with its keywords; both on a file system that all executors see.

    The rows are dealt to tasks by number: each reads its rows, unmixes them and writes them to their place in the new
    file, whose header and size are made before. Weights come from the first `weight_events` events, or from all (None).
    """
    keys = fcs.header(path)
    lay = fcs.Layout.of(keys)
    lost = set(p.detectors or []) - set(lay.channels)
    if lost:
        raise ValueError(f"{path}: channels missing: {sorted(lost)}")
    detectors = p.detectors or control.spectral_channels(lay.channels, parameters.non_spectral, parameters.spectral)
    carried = carried_channels(lay.channels, detectors, raw)
    q = checked(p, method, af)
    weights = None
    if method in ("WLS", "Poisson", "FastPoisson"):
        if weight_events is None:
            weights = kernels.weights(unmix.column_mean(_spectral(spark, path, detectors), "spectral", len(detectors)))
        else:
            weights = kernels.weights(fcs.read_rows(path, 0, weight_events)[1][:, [lay.channels.index(d) for d in detectors]].mean(0))
    if af is not None and method in ("PerCellAF", "Joint"):
        options["af"] = af
    if method == "Joint":
        asked = {k: options.pop(k) for k in ("cell_weight", "floor", "af_passes", "af_quantile") if k in options}
        whole = _spectral(spark, path, detectors) if asked.get("cell_weight") or asked.get("af_passes", 1) > 1 else None
        options |= unmix.joint_statistics(whole, q, af, **asked) if whole is not None else {k: v for k, v in asked.items() if k != "af_quantile"}
    kernel, fields = unmix.event_kernel(method, q, weights=weights, **options)
    names = {str(n): f"{n}-A" for n in q.names} | {"AF": "AF-A"}
    columns = [*carried, *[names.get(n, n) for n, _ in fields]]
    base = os.path.splitext(os.path.basename(path))[0]
    target = os.path.join(out, f"{base} {method}.fcs")
    begin = fcs.prepare(target, columns, lay.total, define_keywords(keys, columns, p, af, method, os.path.basename(target), carried, weights, top=parameters.saturation))
    x_at, carried_at = [lay.channels.index(d) for d in detectors], [lay.channels.index(c) for c in carried]
    step = max(1, min(TASK_EVENTS, -(-lay.total // spark.sparkContext.defaultParallelism)))

    def run(batches):
        for batch in batches:
            for start in batch.column(0).to_pylist():
                stop = min(start + step, lay.total)
                for at in range(start, stop, max(1, TASK_EVENTS // 10)):
                    data = fcs.read_rows(path, at, min(at + TASK_EVENTS // 10, stop))[1]
                    done = np.column_stack([data[:, carried_at], *kernel(data[:, x_at])])
                    fcs.place(target, begin, at, np.nan_to_num(done, nan=0.0, posinf=np.inf, neginf=-np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([stop - start], pa.int64())], ["n"])

    if lay.total:
        starts = spark.range(0, lay.total, step, -(-lay.total // step))  # one range of rows a task
        written = starts.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
        if written != lay.total:
            raise RuntimeError(f"{target}: {written} of {lay.total} events written")
    return target


def _spectral(spark: SparkSession, path: str, detectors: list[str]) -> DataFrame:
    fcs.register(spark)
    df = spark.read.format("fcs").option("columns", ",".join(detectors)).load(path)
    return df.select(F.array(*[F.col(f"`{d}`") for d in detectors]).alias("spectral"))


def unmix_folder(spark: SparkSession, folder: str, out: str, p: Panel, parameters: Parameters, at_once: int = 8, **options) -> list[str]:
    """Every event file of a folder (by its extension, in any case), some at once: their tasks share the cluster."""
    os.makedirs(out, exist_ok=True)
    names = sorted(f for f in os.listdir(folder) if re.search(r"\.fcs$", f, re.I))
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(lambda f: unmix_file(spark, os.path.join(folder, f), out, p, parameters, **options), names))


def unmix_tables(events: DataFrame, path: str, p: Panel, **options) -> None:
    """The route at scale: unmixed events as Parquet by sample; all samples run as one job."""
    unmix_events(events, p, **options).write.partitionBy("sample").mode("overwrite").parquet(path)
