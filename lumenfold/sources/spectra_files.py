"""Spectra on disk: CSV tables, matrices embedded in event files, experiment XML, saved unmixing matrices, libraries."""

from __future__ import annotations

import csv
import json
import os
import re
import warnings
import xml.etree.ElementTree as ET
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import kernels
from lumenfold.operators.unmix import Panel
from lumenfold.sources.fcs import header


def read_spectra(spark: SparkSession, path: str, remove: tuple[str, ...] = ()) -> DataFrame:
    """(name, spectrum) of a CSV whose first column is the name; rows divided by their maximum; named rows left out."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    name, *detectors = wide.columns
    spectrum = F.array(*[F.col(f"`{d}`").cast("double") for d in detectors])
    out = wide.select(F.col(f"`{name}`").alias("name"), F.transform(spectrum, lambda v: v / F.array_max(spectrum)).alias("spectrum"))
    return out.where(~F.col("name").isin(list(remove))) if remove else out


def panel(path: str, remove: tuple[str, ...] = ()) -> Panel:
    """The same on the driver."""
    with open(path, newline="") as f:
        rows = list(csv.reader(f))
    keep = [r for r in rows[1:] if r and r[0] not in remove]
    S = np.array([[float(v) for v in r[1:]] for r in keep])
    return Panel([r[0] for r in keep], S / S.max(1, keepdims=True), rows[0][1:])


def write_panel(p: Panel, path: str) -> str:
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["name", *(p.detectors or [f"D{i}" for i in range(p.S.shape[1])])])
        w.writerows([n, *map(repr, map(float, s))] for n, s in zip(p.names, p.S, strict=True))
    return path


def parse_spill(text: str) -> tuple[list[str], np.ndarray]:
    """n, n names and n x n numbers, separated by commas."""
    parts = [p.strip() for p in text.split(",")]
    n = int(parts[0])
    return parts[1 : n + 1], np.array(parts[n + 1 : n + 1 + n * n], dtype=float).reshape(n, n)


def read_embedded(path: str) -> Panel:
    """Spectra that the instrument stored in a file's spill keyword: the rows of its unmixed dyes come first."""
    keys = header(path)
    names, m = parse_spill(keys.get("$SPILL") or keys["$SPILLOVER"])
    dyes = [d for d in re.split(r"[,;|]", keys.get("BDSPECTRAL UNMIXED", "")) if d.strip()]
    return Panel(dyes or names, m[: len(dyes) or None], names)


def clean_url(url: str) -> str:
    """The dye's name in a control's address: what stands after the last backslash and before _Controls.fcs, without a leading
    plate position, what is in brackets, and all from the first underscore on."""
    s = re.sub(r"_Controls\.fcs.*", "", url, flags=re.S)
    s = s.rpartition("\\")[2]
    s = re.sub(r"^[A-Z]\d+\s+", "", s)
    s = re.sub(r" \(.*\)", "", s)
    return s.partition("_")[0]


def read_experiment(path: str, detectors: list[str] | None = None) -> Panel:
    """Spectra of an experiment file: every spillover vector with its control's address; unstained is AF."""
    names, rows = [], []
    for node in ET.parse(path).getroot().iter():
        vector = next((c for c in node if c.tag.rpartition("}")[2] == "_SpilloverVectorArea"), None)
        if vector is None:
            continue
        url = next((c for c in node.iter() if c.tag.rpartition("}")[2] == "_Url"), None)
        values = [float(e.text) for e in vector.iter() if e is not vector and e.text and e.text.strip()] or [float(v) for v in re.split(r"[,;\s]+", (vector.text or "").strip()) if v]
        if values and max(values) > 0:
            name = clean_url(url.text if url is not None and url.text else f"Dye {len(names) + 1}")
            names.append("AF" if name == "Unstained" else name)
            rows.append(values)
    S = np.array(rows)
    return Panel(names, S / S.max(1, keepdims=True), detectors)


def read_channels(columns: list[str], forbidden: str = ",/\\:*?\"<>|", cache: str | None = None) -> list[tuple[str, str]]:
    """(channel, safe name): forbidden characters become underscores. A cached list wins."""
    if cache and os.path.exists(cache):
        with open(cache, newline="") as f:
            return [tuple(r[:2]) for r in list(csv.reader(f))[1:]]
    table = str.maketrans({c: "_" for c in forbidden})
    return [(c, c.translate(table)) for c in columns]


def unmixing_matrix(p: Panel, weights: np.ndarray | None = None) -> Panel:
    """(A'A)^-1 A', or with weights (A'WA)^-1 A'W."""
    return Panel(p.names, kernels.ols(p.S) if weights is None else kernels.wls(p.S, np.asarray(weights)), p.detectors)


def make_folders(base: str, names) -> list[str]:
    out = [os.path.join(base, n) for n in names]
    for d in out:
        os.makedirs(d, exist_ok=True)
    return out


def save_library(spark: SparkSession, path: str, variants: dict[str, np.ndarray], thresholds: dict[str, float], scores: dict[str, float], recommended: dict[str, bool], reference: dict[str, np.ndarray]) -> None:
    """A variant library as two small Parquet tables."""
    rows = [(d, i, v.tolist(), (v - reference[d]).tolist(), float(np.linalg.norm(v - reference[d]))) for d, vs in variants.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "fluorophore string, variant_idx int, spectrum array<double>, delta array<double>, delta_norm double").write.mode("overwrite").parquet(f"{path}/variants")
    rows = [(d, float(thresholds[d]), float(scores[d]), bool(recommended[d])) for d in variants]
    spark.createDataFrame(rows, "fluorophore string, threshold double, score double, recommended boolean").write.mode("overwrite").parquet(f"{path}/dyes")


def usable_dyes(wanted: list[str], variants: dict[str, object], distances: dict[str, object], least: float = 1e-12) -> list[str]:
    """Of the wanted dyes, in their order, those that variants can improve: dyes with variants, one of them at some distance from
    the dye's own spectrum. Those without any distance are a warning; unknown ones go silently."""
    out, still = [], []
    for dye in wanted:
        if dye in variants:
            far = distances.get(dye)
            (out if far is not None and np.size(far) and np.max(far) >= least else still).append(dye)
    if still:
        warnings.warn(f"no variation in the spectra of {', '.join(still)}", stacklevel=2)
    return out


def load_library(spark: SparkSession, path: str):
    """(variants by dye, thresholds, scores, recommended) of the dyes that variants can improve."""
    variants: dict[str, list] = {}
    distances: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/variants").orderBy("fluorophore", "variant_idx").collect():
        variants.setdefault(r["fluorophore"], []).append(r["spectrum"])
        distances.setdefault(r["fluorophore"], []).append(r["delta_norm"])
    dyes = spark.read.parquet(f"{path}/dyes").collect()
    kept = {d: np.array(variants[d]) for d in usable_dyes(list(variants), variants, distances)}
    return kept, {r["fluorophore"]: r["threshold"] for r in dyes}, {r["fluorophore"]: r["score"] for r in dyes}, {r["fluorophore"]: r["recommended"] for r in dyes}


def save_gates(path: str, gates: dict[str, list[tuple[float, float]]]) -> str:
    with open(path, "w") as f:
        json.dump({n: {"x": [p[0] for p in g], "y": [p[1] for p in g]} for n, g in gates.items()}, f)
    return path


def load_gates(path: str) -> dict[str, list[tuple[float, float]]]:
    with open(path) as f:
        return {n: list(zip(g["x"], g["y"], strict=True)) for n, g in json.load(f).items()}


# Months in time stamps, whatever the locale.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()

# --- keywords of unmixed files ----------------------------------------------------------------------------


def define_keywords(keys: dict[str, str], columns: list[str], p: Panel, af: Panel | None, method: str, file_name: str, carried: list[str], weights=None, markers: dict[str, str] | None = None, top: float = 4194304.0, when: datetime | None = None) -> dict[str, str]:
    """Keywords of an unmixed file: what describes no parameter stays; each column is described by its class (background
    index, background amount, carried channel, dye); spectra, background and weights are embedded as text, each after its size
    and names. `when` is the time of the change (else now), in days, months and hundredths of a second."""
    out = {k: v for k, v in keys.items() if not re.match(r"\$?P\d+", k) and k not in ("$BEGINDATA", "$ENDDATA")}
    old = {}
    for k, name in keys.items():
        m = re.fullmatch(r"\$?P(\d+)N", k)
        if m and name in carried:
            old[name] = {s.group(1): v for q, v in keys.items() if (s := re.fullmatch(rf"\$?P{m[1]}([A-Z]+)", q))}
    for i, c in enumerate(columns, 1):
        name = c.replace(",", "_")
        if c == "AF Index":
            own = {"S": "Autofluorescence Index", "R": str(len(af.S) if af else 1)}
        elif c == "AF-A":
            own = {"S": "Autofluorescence", "R": str(top)}
        elif c in carried:
            own = {k: v for k, v in old.get(c, {}).items() if k != "N"}
        else:
            own = {"S": (markers or {}).get(c.removesuffix("-A"), ""), "R": str(top)}
        own = {"N": name, "B": "32", "E": "0,0", "R": str(top)} | own | {"N": name, "B": "32"}
        out |= {f"$P{i}{k}": v for k, v in own.items() if v != ""}

    def listed(q: Panel) -> str:
        return ",".join([str(len(q.names)), str(q.S.shape[1]), *map(str, q.names), *(q.detectors or []), *[f"{v:.8g}" for v in q.S.ravel()]])

    when = when or datetime.now()
    stamp = f"{when.day:02d}-{MONTHS[when.month - 1]}-{when.year:04d} {when:%H:%M:%S}.{when.microsecond // 10_000:02d}"
    out |= {"UNMIXINGMETHOD": method, "$FIL": file_name, "SPECTRA": listed(p), "FLUOROCHROMES": ",".join(map(str, p.names))}
    out |= {"$LAST_MODIFIED": stamp, "$LAST_MODIFIER": "lumenfold", "$ORIGINALITY": "DataModified"}
    if af is not None:
        out["AUTOFLUORESCENCE"] = listed(af)
    if weights is not None:
        out["WEIGHTS"] = ",".join([str(len(weights)), *(p.detectors or []), *(f"{v:.8g}" for v in weights)])
    return out


def carried_channels(columns: list[str], detectors: list[str], raw: bool = False) -> list[str]:
    """Columns that pass through unmixing: no detectors (unless asked) and none of their -H and -W siblings."""
    stems = {re.sub(r"-A$", "", d) for d in detectors}
    return [c for c in columns if (raw and c in detectors) or (c not in detectors and re.sub(r"-[HW]$", "", c) not in stems)]
