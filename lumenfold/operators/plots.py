"""Data behind plots of unmixed events: panels of pairs, hexagons, axes; lines of background quality."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.stats import histogram, quantiles
from lumenfold.operators.spectra import cosine_cross
from lumenfold.operators.unmix import Panel


def axis_low(df: DataFrame, channel: str, least: float = -1000.0) -> float:
    """Where an axis begins: twice the 0.01 quantile, at most `least`."""
    q = quantiles(df.select(F.col(channel).alias("_v")), [], "_v", 0.01, "_q").first()["_q"]
    return least if q is None else min(2 * q, least)


def hexagons(df: DataFrame, x, y, x_lim: tuple[float, float], y_lim: tuple[float, float], bins: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cx, cy, n): events in hexagons, `bins` of them along x; cx and cy are the centres. Of the two interleaved
    lattices a point counts in the nearer centre's; an event on the edge goes to the first."""
    sx = bins / (x_lim[1] - x_lim[0])
    sy = bins / (math.sqrt(3.0) * (y_lim[1] - y_lim[0]))
    u, v = (x - F.lit(x_lim[0])) * F.lit(sx), (y - F.lit(y_lim[0])) * F.lit(sy)
    i1, j1, i2, j2 = F.floor(u + 0.5), F.floor(v + 0.5), F.floor(u), F.floor(v)
    near = (u - i1) ** 2 + 3 * (v - j1) ** 2 <= (u - i2 - 0.5) ** 2 + 3 * (v - j2 - 0.5) ** 2
    cx = F.when(near, i1.cast("double")).otherwise(i2 + 0.5) / F.lit(sx) + F.lit(x_lim[0])
    cy = F.when(near, j1.cast("double")).otherwise(j2 + 0.5) / F.lit(sy) + F.lit(y_lim[0])
    return df.groupBy(*keys, cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def pair_panels(df: DataFrame, pairs: list[tuple[str, str]], limits: dict[str, tuple[float, float]], bins: int = 64) -> DataFrame:
    """(x, y, cx, cy, n): hexagon counts of pairs of channels, each scaled to 0..1 within its limits; all pairs in one pass."""
    unit = lambda c: (F.col(f"`{c}`") - F.lit(limits[c][0])) / F.lit(limits[c][1] - limits[c][0])
    spots = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), unit(a).alias("u"), unit(b).alias("v")) for a, b in pairs])
    long = df.select(F.explode(spots).alias("p")).select("p.*")
    return hexagons(long, F.col("u"), F.col("v"), (0.0, 1.0), (0.0, 1.0), bins, ("x", "y"))


def triangle(df: DataFrame, channels: list[str], limits: dict[str, tuple[float, float]], bins: int = 64) -> DataFrame:
    """Panels of all pairs of channels below the diagonal: x before y in the channels' order."""
    return pair_panels(df, list(combinations(channels, 2)), limits, bins)


def grid(df: DataFrame, across: list[str], down: list[str], limits: dict[str, tuple[float, float]], bins: int = 64) -> DataFrame:
    """Panels of every channel of one list against every channel of another."""
    return pair_panels(df, [(a, b) for b in down for a in across if a != b], limits, bins)


def diagonal(df: DataFrame, channels: list[str], limits: dict[str, tuple[float, float]], bins: int = 64) -> DataFrame:
    """(channel, bin, n): the histograms on the diagonal."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), ((F.col(f"`{c}`") - F.lit(limits[c][0])) / F.lit(limits[c][1] - limits[c][0])).alias("v")) for c in channels])).alias("p")).select("p.*")
    return histogram(long, ["channel"], F.col("v"), 0.0, 1.0, bins)


def background_quality(af: Panel, dyes: Panel, threshold: float = 0.99) -> list[tuple[str, str, float, int, float, float]]:
    """(background row, dye, similarity, detector, background value, dye value): both lines of each background row that is more
    like its nearest dye than the threshold."""
    c = cosine_cross(af.S, dyes.S)
    out = []
    for i in np.flatnonzero(c.max(1) > threshold):
        j = int(c[i].argmax())
        out += [(str(af.names[i]), str(dyes.names[j]), float(c[i, j]), d, float(a), float(b)) for d, (a, b) in enumerate(zip(af.S[i], dyes.S[j], strict=True))]
    return out
