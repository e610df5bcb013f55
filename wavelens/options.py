"""Options of a fit and of a search, checked once.

Wrong values raise ValueError; what has a sensible default instead is repaired
with a warning, as the tables below say."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

LEVELS, DERIVATIVES, BOTH = "d0_L2", "d1_L2", "d0_d1_L2"
DISTANCES = (LEVELS, DERIVATIVES, BOTH)
STOPS = ("max", "mean", "quantile")
#: What a fit does with curves that have nowhere c points in a row.
SHORT = ("refuse", "overlap")


def _whole(v, least: int) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and float(v).is_integer() and v >= least


def recycled(values, n: int) -> list:
    """values repeated in turn up to n (a scalar n times)."""
    values = list(values) if isinstance(values, Sequence) and not isinstance(values, str) else [values]
    return [values[i % len(values)] for i in range(n)]


@dataclass(frozen=True)
class FitOptions:
    """K clusters; c least and c_max largest motif length (one or K values);
    distance and alpha (share of the derivative part); w weights of dimensions;
    m fuzziness; short_curves: a curve without c points in a row is an error
    (refuse), or lies where it overlaps most (overlap); the others steer
    iteration, elongation, gaps and cleaning."""

    K: int
    c: int | Sequence[int]
    c_max: float | Sequence[float] = math.inf
    standardize: bool = False
    distance: str = LEVELS
    alpha: float | None = None
    w: float | Sequence[float] = 1.0
    m: float = 2.0
    iter_max: int = 1000
    stop_criterion: str = "max"
    quantile: float | None = None
    tol: float = 1e-8
    iter4elong: int = 10
    tol4elong: float = 1e-3
    max_elong: float = 0.5
    trials_elong: int = 10
    deltaJk_elong: float = 0.05
    max_gap: float = 0.2
    iter4clean: int = 50
    tol4clean: float = 1e-4
    quantile4clean: float | None = None
    seed: int = 1
    short_curves: str = "refuse"

    def checked(self, n_curves: int | None = None, dims: int = 1) -> FitOptions:
        o = self
        if o.distance not in DISTANCES:
            raise ValueError(f"distance is one of {DISTANCES}")
        if not _whole(o.K, 1):
            raise ValueError("K is one integer of 1 or more")
        if n_curves is not None and n_curves < 5:
            raise ValueError("at least 5 curves are needed")
        for name, values in (("c", o.c), ("c_max", o.c_max)):
            given = list(values) if isinstance(values, Sequence) else [values]
            if len(given) not in (1, o.K) or not all(_whole(v, 2) or (name == "c_max" and v == math.inf) for v in given):
                raise ValueError(f"{name} has one or K integers of 2 or more")
        o = replace(o, c=tuple(int(v) for v in recycled(o.c, o.K)), c_max=tuple(recycled(o.c_max, o.K)))
        if o.distance == BOTH:
            alpha = o.alpha
            if not isinstance(alpha, (int, float)) or not 0 <= alpha <= 1:
                warnings.warn("alpha isn't in [0, 1]; 0.5 is used", stacklevel=2)
                alpha = 0.5
            o = replace(o, alpha=float(alpha), distance={0: LEVELS, 1: DERIVATIVES}.get(alpha, BOTH))
        o = replace(o, alpha={LEVELS: 0.0, DERIVATIVES: 1.0}.get(o.distance, o.alpha))
        weights = list(o.w) if isinstance(o.w, Sequence) else [o.w]
        if len(weights) not in (1, dims) or not all(isinstance(v, (int, float)) and v > 0 for v in weights):
            raise ValueError("w has one or d positive numbers")
        o = replace(o, w=tuple(float(v) for v in recycled(weights, dims)))
        positive = {"m": o.m > 1, "iter_max": _whole(o.iter_max, 1), "tol": o.tol > 0, "iter4elong": _whole(o.iter4elong, 1), "tol4elong": o.tol4elong > 0, "max_elong": o.max_elong > 0, "trials_elong": _whole(o.trials_elong, 1), "deltaJk_elong": o.deltaJk_elong > 0, "max_gap": o.max_gap >= 0, "iter4clean": _whole(o.iter4clean, 1), "tol4clean": o.tol4clean > 0}
        for name, right in positive.items():
            if not right:
                raise ValueError(f"{name} is out of range")
        if o.stop_criterion not in STOPS:
            raise ValueError(f"stop_criterion is one of {STOPS}")
        if o.short_curves not in SHORT:
            raise ValueError(f"short_curves is one of {SHORT}")
        if o.stop_criterion == "quantile" and not (isinstance(o.quantile, (int, float)) and 0 <= o.quantile <= 1):
            raise ValueError("quantile is in [0, 1]")
        q = 1 / o.K if o.quantile4clean is None else o.quantile4clean
        if not 0 < q <= 1 or (n_curves is not None and q * n_curves < 1):
            raise ValueError("quantile4clean is over 1 / number of curves and at most 1")
        return replace(o, quantile4clean=float(q))

    def channel_weights(self, dims: int) -> list[float]:
        """Weight of each value column in the distance: levels, then derivatives."""
        out = []
        if self.distance != DERIVATIVES:
            out += [(1 - self.alpha) * v / dims for v in self.w]
        if self.distance != LEVELS:
            out += [self.alpha * v / dims for v in self.w]
        return out


def check_filter(sil_threshold: float, size_threshold: int) -> None:
    if not -1 <= sil_threshold <= 1:
        raise ValueError("sil_threshold is in [-1, 1]")
    if not _whole(size_threshold, 1):
        raise ValueError("size_threshold is an integer of 1 or more")


def check_plot(freq_threshold: int, top_n: int | str, most: int) -> None:
    if freq_threshold > most:
        raise ValueError(f"freq_threshold is over the largest frequency, {most}")
    if top_n != "all" and not _whole(top_n, 1):
        raise ValueError("top_n is 'all' or an integer of 1 or more")
