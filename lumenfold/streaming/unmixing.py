"""Unmixing of event streams: with fixed spectra every event stands alone, so the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import unmix
from lumenfold.operators.unmix import Panel


def unmix_stream(stream: DataFrame, panel: Panel, method: str = "OLS", array_col: str = "spectral", **options) -> DataFrame:
    """A streaming frame with abundances. Methods that need a statistic of all events want it given (weights)."""
    if method in ("WLS", "Poisson") and options.get("weights") is None:
        raise ValueError(f"{method} on a stream needs weights: they cannot be taken over an unbounded stream")
    if method == "Joint" and (options.get("cell_weight") or options.get("af_passes", 1) > 1):
        raise ValueError("quantiles and means over all events are for batches")
    return unmix.METHODS[method](stream, panel, array_col=array_col, **options)


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each key by event-time window; rows later than the watermark are left out."""
    s = stream.withWatermark(time_col, late)
    return s.groupBy(F.window(time_col, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
