"""Numeric kernels on one curve, for Arrow batches (the relational operators
define the same results; tests hold both against each other).

A curve or motif is a matrix of points by channels (weighted value columns),
rows of NaN where points are missing."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def window(y: np.ndarray, s: int, length: int) -> np.ndarray:
    """Rows s .. s + length - 1, counted from 1; NaN outside the curve (PR7)."""
    out = np.full((length, y.shape[1]), np.nan)
    a, b = max(1, s), min(len(y), s + length - 1)
    if a <= b:
        out[a - s : b - s + 1] = y[a - 1 : b]
    return out


def _mean_squares(w: np.ndarray, v: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances (NaN without overlap) and overlaps of windows (shifts, channels, length)."""
    inside = ~np.isnan(v[:, 0])
    w = w[:, :, inside]
    n = (~np.isnan(w[:, 0])).sum(1)
    gap = w - v[inside].T
    ss = np.nansum(gap * gap * weights[:, None], axis=(1, 2))
    return np.where(n > 0, ss / np.maximum(n, 1), np.nan), n


def shift_range(n: int, length: int, c_k: int, contained: bool) -> tuple[int, int]:
    """First and last shift. A curve of less than c_k points takes the other way
    round: there it lies within the motif."""
    if contained:
        return 1, n - length + 1
    low, high = 1 - (length - c_k), n - c_k + 1
    return min(low, high), max(low, high)


def longest_run(y: np.ndarray) -> int:
    """Points of the longest interval without a gap."""
    there = np.concatenate([[False], ~np.isnan(y[:, 0]), [False]])
    ends = np.flatnonzero(there[1:] != there[:-1])
    return int(np.diff(ends)[::2].max(initial=0))


def best_shift(y: np.ndarray, v: np.ndarray, c_k: int, weights: np.ndarray, contained: bool = False) -> tuple[int, float]:
    """Shift and distance of the best alignment; (0, NaN) if no point overlaps."""
    length = len(v)
    low, high = shift_range(len(y), length, c_k, contained)
    if high < low:
        return 0, np.nan
    padded = window(y, low, high - low + length)
    d, n = _mean_squares(sliding_window_view(padded, length, axis=0), v, weights)
    most = n.max(initial=0)
    if not most:
        return 0, np.nan
    d = np.where((n >= min(c_k, most)) & (n > 0), d, np.inf)
    k = int(np.argmin(d))
    return low + k, float(d[k])


def block_distances(x: np.ndarray, y: np.ndarray, least: int, weights: np.ndarray, contained: bool = False) -> np.ndarray:
    """Distances of `best_shift` of all pairs of two blocks of pieces (pieces,
    points, channels), those of y the shorter ones; NaN without overlap."""
    length, low_high = y.shape[1], shift_range(x.shape[1], y.shape[1], least, contained)
    spans = [(max(1, s), min(x.shape[1], s + length - 1), s) for s in range(low_high[0], low_high[1] + 1)]
    spans = [(slice(a - 1, b), slice(a - s, b - s + 1)) for a, b, s in spans if a <= b]
    there, here = ~np.isnan(x[:, :, 0]), ~np.isnan(y[:, :, 0])
    gaps = not (there.all() and here.all())
    if gaps:
        x, y = np.where(there[:, :, None], x, 0.0), np.where(here[:, :, None], y, 0.0)
        there, here = there.astype(float), here.astype(float)
        counts = [there[:, p] @ here[:, q].T for p, q in spans]
        enough = np.minimum(least, np.max(counts, axis=0)) if counts else None
    best, gap = np.full((len(x), len(y)), np.inf), np.empty((len(x), len(y)))
    for i, (p, q) in enumerate(spans):
        ss = np.zeros_like(gap)
        for j, k in zip(range(p.start, p.stop), range(q.start, q.stop), strict=True):
            for c in np.flatnonzero(weights):
                np.subtract(x[:, j, c, None], y[None, :, k, c], out=gap)
                np.multiply(gap, gap, out=gap)
                if gaps:
                    np.multiply(gap, there[:, j, None], out=gap)
                    np.multiply(gap, here[None, :, k], out=gap)
                if weights[c] != 1:
                    np.multiply(gap, weights[c], out=gap)
                np.add(ss, gap, out=ss)
        if gaps:
            ss = np.where((counts[i] >= enough) & (counts[i] > 0), ss / np.maximum(counts[i], 1), np.inf)
        else:
            np.divide(ss, p.stop - p.start, out=ss)
        np.minimum(best, ss, out=best)
    best[np.isinf(best)] = np.nan
    return best


#: Pieces of a side that are laid on each other at once: a matrix stays in the cache.
_TILE = 256


def block_sums(x: np.ndarray, y: np.ndarray | None, least: int, weights: np.ndarray, contained: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of x, then for each of y: sum and number of its distances
    to the pieces of the other block; y None: to the other pieces of x."""
    other = x if y is None else y
    # Those without gaps, which take less work, come together.
    of = [np.argsort(np.isnan(b[:, :, 0]).any(1), kind="stable") for b in (x, other)]
    out = [np.zeros((len(b), 2)) for b in (x, other)]
    for i in range(0, len(x), _TILE):
        for j in range(0, len(other), _TILE):
            a, b = of[0][i : i + _TILE], of[1][j : j + _TILE]
            if x.shape[1] >= other.shape[1]:
                d = block_distances(x[a], other[b], least, weights, contained)
            else:
                d = block_distances(other[b], x[a], least, weights, contained).T
            if y is None and i == j:
                d[np.arange(len(a)), np.arange(len(a))] = np.nan
            known = ~np.isnan(d)
            d = np.where(known, d, 0.0)
            out[0][a] += np.stack([d.sum(1), known.sum(1)], 1)
            out[1][b] += np.stack([d.sum(0), known.sum(0)], 1)
    return out[0], out[1]


def distance_at(y: np.ndarray, v: np.ndarray, s: int, weights: np.ndarray) -> tuple[float, int]:
    d, n = _mean_squares(window(y, s, len(v)).T[None], v, weights)
    return float(d[0]), int(n[0])


def contribution(y: np.ndarray, s: int, p: float, m: float, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What a member adds to a center over the domain `inside`: weighted values
    and weights at each position; None without a common point."""
    w = window(y, s, len(inside))
    there = inside & ~np.isnan(w[:, 0])
    n = there.sum()
    if not n or p <= 0:
        return None
    c = np.where(there, p**m / n, 0.0)
    return np.where(there[:, None], w, 0.0) * c[:, None], c


def fuzzy(d: np.ndarray, m: float) -> np.ndarray:
    """Memberships of one curve from its distances (NaN: none)."""
    zero = np.flatnonzero(d == 0)
    if len(zero):
        return (np.arange(len(d)) == zero[0]).astype(float)
    with np.errstate(invalid="ignore"):
        w = np.where(d > 0, d, np.inf) ** (-1.0 / (m - 1))
    return w / w.sum() if w.sum() > 0 else np.zeros(len(d))


def trim(v: np.ndarray) -> tuple[np.ndarray, int]:
    """The center from its first to its last point, and what went on the left."""
    there = np.flatnonzero(~np.isnan(v[:, 0]))
    return v[there[0] : there[-1] + 1], int(there[0])
