"""Vectorised hashing of byte strings, and anchors that their content alone picks."""

from __future__ import annotations

import numpy as np

#: Starts handled at a time.
PIECE = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^n and their inverses, modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(12, int(n).bit_length())
        for name, base in (("up", _B), ("down", _B_INVERSE)):
            p = np.full(size + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any substrings of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m] + np.uint64(k))


def pieces(texts: list, length: int):
    """(owner, offset) and content of pieces with at most PIECE starts together: short texts joined, long ones cut, overlapping."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, PIECE):
            part = t[at : at + PIECE + length - 1]
            if size + len(part) > PIECE and parts:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append((i, at))
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def intervals(g: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor position, part) of all intervals of starts, in joined parts of these sizes.

    g are the hashes of all substrings of length k; the windows in an interval have the same leftmost least one.
    """
    width = length - k + 1
    rows = -(-len(g) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(g)] = g
    grid = grid.reshape(rows, width)
    where = np.arange(rows * width).reshape(rows, width)
    # leftmost least hash from the start of each row, and to the end of each row; a window is the end of one row and the start of the next
    ahead = np.minimum.accumulate(grid, axis=1)
    new = np.ones(grid.shape, dtype=bool)
    new[:, 1:] = grid[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, where, 0), axis=1).ravel()
    ahead = ahead.ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)
    new[:, 1:] = grid[:, ::-1][:, 1:] <= back[:, :-1]
    back_at = np.minimum.accumulate(np.where(new, where[:, ::-1], np.iinfo(np.int64).max), axis=1)[:, ::-1].ravel()
    back = back[:, ::-1].ravel()
    ends = np.cumsum(sizes)
    p = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(ends - sizes, ends, strict=True)])
    own = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    q = p + width - 1
    at = np.where(back[p] <= ahead[q], back_at[p], ahead_at[q])
    cut = np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1
    begin = np.concatenate([[0], cut])
    return p[begin], p[np.concatenate([cut - 1, [len(p) - 1]])], at[begin], own[begin]
