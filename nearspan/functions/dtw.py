"""Dynamic time warping of number series, many pairs at once."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, inf

import numpy as np

_DISTANCES = {"l1": np.abs, "l2_squared": np.square}


def _series(values: Sequence[float]) -> np.ndarray:
    x = np.array([float("nan") if v is None else v for v in values], float)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("a series needs one value at least, and finite values alone")
    return x


def radius(m: int, n: int, window: int | None, window_fraction: float | None) -> int:
    if window is not None and window_fraction is not None:
        raise ValueError("give window or window_fraction, not both")
    if window_fraction is not None:
        if not 0 < window_fraction <= 1:
            raise ValueError("window_fraction must be above 0 and 1 at most")
        return ceil(window_fraction * max(m, n))
    if window is not None and window < 0:
        raise ValueError("window must not be negative")
    return max(m, n) if window is None else min(window, max(m, n))


def _wavefront(x: np.ndarray, y: np.ndarray, band: np.ndarray, m: np.ndarray, n: np.ndarray, distance: str) -> np.ndarray:
    """Costs of pairs of rows of x and y by antidiagonals; a cell reads the two antidiagonals before its own."""
    lanes, rows, width = len(x), x.shape[1], y.shape[1]
    before = np.full((2, lanes, rows + 1), inf)  # by i, of i + j = d - 2 and d - 1
    before[0, :, 0] = 0.0
    out = np.full(lanes, inf)
    every, measure = np.arange(lanes), _DISTANCES[distance]
    for d in range(2, rows + width + 1):
        low, high = max(1, d - width), min(rows, d - 1)
        i = np.arange(low, high + 1)
        j = d - i
        cost = measure(x[:, i - 1] - y[:, j - 1])
        best = np.minimum(before[0][:, i - 1], np.minimum(before[1][:, i - 1], before[1][:, i]))
        now = np.full((lanes, rows + 1), inf)
        now[:, i] = np.where(np.abs(i - j) <= band[:, None], cost + best, inf)
        done = m + n == d
        out[done] = now[every[done], m[done]]
        before[0], before[1] = before[1], now
    return out


def dtw(queries: Sequence[Sequence[float]], targets: Sequence[Sequence[float]], window: int | None = None, distance: str = "l2_squared", cutoff: float | None = None, window_fraction: float | None = None) -> np.ndarray:
    """Summed costs along the best warping paths within a band about the diagonal.

    Infinite where the band holds no path, or the cost is above ``cutoff``.
    """
    if distance not in _DISTANCES:
        raise ValueError(f"distance must be one of {', '.join(_DISTANCES)}")
    a, b = [_series(s) for s in queries], [_series(s) for s in targets]
    out = np.full(len(a), inf)
    m, n = np.array([len(s) for s in a], int), np.array([len(s) for s in b], int)
    band = np.array([radius(p, q, window, window_fraction) for p, q in zip(m, n)], int)
    open_ = np.abs(m - n) <= band
    if cutoff is not None:
        open_ &= np.array([keogh(x, y, r, distance) <= cutoff if len(x) == len(y) else True for x, y, r in zip(a, b, band)], bool)
    order = np.flatnonzero(open_)
    order = order[np.argsort(m[order] + n[order], kind="stable")]
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        x, y = (np.zeros((len(part), max(len(s[i]) for i in part))) for s in (a, b))
        for k, i in enumerate(part):
            x[k, : m[i]], y[k, : n[i]] = a[i], b[i]
        out[part] = _wavefront(x, y, band[part], m[part], n[part], distance)
    return np.where(out > cutoff, inf, out) if cutoff is not None else out


def keogh(query: np.ndarray, target: np.ndarray, band: int, distance: str = "l2_squared") -> float:
    """Lower bound of the cost for series of one length: how far the target leaves the query's envelope."""
    padded = lambda fill: np.lib.stride_tricks.sliding_window_view(np.pad(query, band, constant_values=fill), 2 * band + 1)
    low, high = padded(inf).min(axis=1), padded(-inf).max(axis=1)
    return float(_DISTANCES[distance](np.maximum(0, np.maximum(target - high, low - target))).sum())
