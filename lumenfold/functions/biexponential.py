"""Biexponential display scale: a sum of two exponentials, linear around zero and logarithmic far from it, tabulated once
and interpolated in both directions. The published parameters: channels, top value, decades above and below zero, width."""

from __future__ import annotations

import numpy as np


def _second_rate(b: float, w: float) -> float:
    """d in (0, b] with 2 (ln d - ln b) + w (b + d) = 0."""
    if w <= 0:
        return b
    lo, hi = 1e-12, b
    for _ in range(200):
        d = (lo + hi) / 2
        lo, hi = (d, hi) if 2 * np.log(d / b) + w * (b + d) < 0 else (lo, d)
    return (lo + hi) / 2


class Biexponential:
    """f(y) = m (e^(b y) - s e^(-d y) - c) on 0..1 above its zero, mirrored below it; the axis has `channels` steps."""

    def __init__(self, channels: int = 4096, top: float = 262144.0, positive: float = 4.5, negative: float = 0.0, width: float = -10.0):
        decades = np.log10(-width) if width < -1 else 0.5  # extent of the linear part
        extra = max(negative, 0.0) + decades / 2
        above = max(positive - decades / 2, 0.1)
        zero = min(extra / (extra + above), 0.5)
        span = extra / zero  # decades of the whole axis
        w = decades / (2 * span)
        b = np.log(10) * span
        d = _second_rate(b, w)
        y = np.linspace(0, 1, channels + 1)
        at = round(zero * channels)
        up, down = np.exp(b * y), np.exp(-d * y) * np.exp((b + d) * (w + extra / span))
        values = top / np.exp(b) * (up - down - (up[at] - down[at]))
        values[:at] = -values[2 * at : at : -1]
        self.axis, self.values, self.channels, self.top = y * channels, values, channels, top

    def __call__(self, x):
        """Channel of values; beyond the table's ends, its ends."""
        return np.interp(np.asarray(x, dtype=float), self.values, self.axis)

    def inverse(self, channel):
        return np.interp(np.asarray(channel, dtype=float), self.axis, self.values)


def width_for(lowest: float) -> float:
    """A wider linear part where values go far below zero."""
    return -1000.0 if lowest < -1000 else -100.0 if lowest < -100 else -10.0
