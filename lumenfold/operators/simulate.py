"""Simulated events with ground truth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Detector noise of the instruments (counts per unit, deviation of the readout noise, dark offset); others use
# the first.
NOISE = {
    "": (6e-3, 80.0, 50.0),
    "aurora": (5e-3, 80.0, 50.0),
    "auroraNL": (5e-3, 80.0, 50.0),
    "id7000": (8e-3, 60.0, 40.0),
    "s8": (2e-3, 200.0, 120.0),
    "a8": (2e-3, 200.0, 120.0),
    "opteon": (8e-3, 50.0, 30.0),
    "mosaic": (6e-3, 70.0, 45.0),
    "xenith": (6e-3, 70.0, 45.0),
    "a5se": (7e-3, 65.0, 40.0),
}
#: Share of the top signal, by layer.
LAYERS = (0.5, 0.05, 0.005)


def simulate(spark: SparkSession, S: np.ndarray, n: int = 10_000, complexity: float = 1 / 3, af: np.ndarray | None = None, variants: dict[int, np.ndarray] | None = None, top: float = 4194304.0, cytometer: str = "", seed: int = 1, partitions: int = 8, counts_per_unit: float | None = 0.5) -> DataFrame:
    """(event_id, fsc, ssc, spectral, abundance, layer, variant, af_row, af_amount): max(1, round(complexity F)) dyes of each
    event are on, at a high, middle or low layer (log-normal about it); background scales with scatter; shot noise of
    signal x counts_per_unit counts (None: the instrument's own), readout noise, less the dark offset.

    Event i depends on (seed, i // 1024) alone, so results do not change with partitions.
    """
    S = np.asarray(S, dtype=float)
    F, D = S.shape
    on = max(1, round(complexity * F))
    own, readout, offset = NOISE.get(cytometer, NOISE[""])
    gain = 1 / (counts_per_unit or own)
    variants = variants or {}

    def block(b: int, ids: np.ndarray):
        rng = np.random.default_rng([seed, b])
        m = 1024
        z = rng.normal(size=(m, 2))
        fsc = np.exp(11 + 0.3 * z[:, 0])
        ssc = np.exp(10 + 0.5 * (0.6 * z[:, 0] + 0.8 * z[:, 1]))
        layer = np.full((m, F), -1)
        rank = rng.random((m, F)).argsort(1)
        layer[rank < on] = rng.integers(0, len(LAYERS), (rank < on).sum())
        mean = np.where(layer >= 0, np.array([*LAYERS, 0.0])[layer] * top / 4, 0)
        u = mean * np.exp(0.2 * rng.normal(size=(m, F)) - 0.02)
        variant = np.zeros((m, F), dtype=int)
        signal = np.zeros((m, D))
        for f in range(F):
            lib = variants.get(f)
            if lib is None:
                signal += u[:, f : f + 1] * S[f]
            else:
                variant[:, f] = rng.integers(0, len(lib), m)
                signal += u[:, f : f + 1] * lib[variant[:, f]]
        row, amount = np.zeros(m, dtype=int), np.zeros(m)
        if af is not None:
            row = rng.integers(0, len(af), m)
            robust = (ssc - np.median(ssc)) / (1.4826 * np.median(np.abs(ssc - np.median(ssc))))
            amount = np.maximum(0.002 * top * np.exp(0.3 * robust), 0)
            signal += amount[:, None] * np.asarray(af)[row]
        noisy = rng.poisson(np.clip(signal / gain, 0, 1e12)) * gain + rng.normal(0, readout, (m, D)) - offset
        at = ids - b * 1024
        return [x[at] for x in (fsc, ssc, noisy, u, layer, variant, row + (af is not None), amount)]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for b in np.unique(ids // 1024):
                own = ids[ids // 1024 == b]
                parts = block(int(b), own)
                lists = [pa.array(p.tolist()) if p.ndim == 2 else pa.array(p) for p in parts]
                names = ["event_id", "fsc", "ssc", "spectral", "abundance", "layer", "variant", "af_row", "af_amount"]
                yield pa.RecordBatch.from_arrays([pa.array(own), *lists], names)

    schema = "event_id long, fsc double, ssc double, spectral array<double>, abundance array<double>, layer array<long>, variant array<long>, af_row long, af_amount double"
    return spark.range(0, n, 1, partitions).mapInArrow(run, schema)
