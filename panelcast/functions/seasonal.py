"""Robust seasonal-trend decomposition by loess, for many series of one length at a time.

The method is the published one (Cleveland et al., 1990). Loess neighbourhoods depend on the
position alone, so each smoothing step is one weighted sum over a fixed index grid.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.batches import by_length, evaluated_once, to_lists

# --- fixed values: smoothing spans for monthly data, and iteration counts --------------------
PERIOD = 12
SEASONAL_SPAN = 7
TREND_SPAN = 23
LOW_PASS_SPAN = 13
INNER_ROUNDS = 2
ROBUST_ROUNDS = 15


@lru_cache(maxsize=512)
def _grid(n: int, span: int, extend: bool) -> list[np.ndarray]:
    """Base weight times offset**k (k = 0, 1, 2) of every point for every evaluated position.

    ``extend`` adds one position before the first and one after the last point.
    """
    width = min(span, n)
    at = np.arange(-1, n + 1) if extend else np.arange(n)
    left = np.clip(at - (span + 1) // 2 + 1, 0, n - width)
    reach = np.maximum(at - left, left + width - 1 - at).astype(float)
    if span > n:
        reach += (span - n) // 2
    offset = np.arange(n)[:, None] - at
    gap = np.abs(offset)
    near = (np.arange(n)[:, None] >= left) & (np.arange(n)[:, None] < left + width)
    weight = np.where(gap <= 0.001 * reach, 1.0, (1 - (gap / np.maximum(reach, 1)) ** 3) ** 3)
    weight = np.where(near & (gap <= 0.999 * reach), weight, 0.0)
    return [weight * offset**k for k in range(3)]


def _loess(y: np.ndarray, span: int, robust: np.ndarray | None, extend: bool = False):
    """Locally linear smooth of every row of ``y``: weighted sums are matrix products."""
    n = y.shape[1]
    w0, w1, w2 = _grid(n, span, extend)
    rw = np.ones((1, n)) if robust is None else robust
    total = rw @ w0
    usable = total > 0
    total = np.where(usable, total, 1.0)
    centre = (rw @ w1) / total
    spread = (rw @ w2) / total - centre**2
    wy = rw * y
    level = (wy @ w0) / total
    tilt = np.sqrt(np.maximum(spread, 0)) > 0.001 * (n - 1)
    slope = np.where(tilt, ((wy @ w1) / total - centre * level) / np.where(tilt, spread, 1.0), 0.0)
    out = level - centre * slope
    if not extend:
        return np.where(usable, out, y)
    # An end without any weight repeats the smoothed value next to it.
    inner = np.where(usable[:, 1:-1], out[:, 1:-1], y)
    return np.where(usable, out, np.concatenate([inner[:, :1], inner, inner[:, -1:]], axis=1))


def _moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    c = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    return (c[:, width:] - c[:, :-width]) / width


def _cycle(detrended: np.ndarray, robust: np.ndarray | None) -> np.ndarray:
    """Smooth each calendar month's own sub-series, extended by one season on both sides.

    The first ``n % 12`` months have one year more than the others; each kind is one stack.
    """
    m, n = detrended.shape
    years, extra = divmod(n, PERIOD)
    out = np.empty((m, n + 2 * PERIOD))
    for months, length in ((range(extra), years + 1), (range(extra, PERIOD), years)):
        if not len(months):
            continue
        at = np.add.outer(np.array(months), PERIOD * np.arange(length + 2))
        inner = at[:, :length]
        part = detrended[:, inner].reshape(-1, length)
        weights = None if robust is None else robust[:, inner].reshape(-1, length)
        out[:, at] = _loess(part, SEASONAL_SPAN, weights, extend=True).reshape(m, *at.shape)
    return out


def decompose(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) of each row; rows have more than two seasons."""
    n = y.shape[1]
    trend = np.zeros_like(y)
    seasonal = np.zeros_like(y)
    robust = None
    for outer in range(ROBUST_ROUNDS + 1):
        for _ in range(INNER_ROUNDS):
            cycle = _cycle(y - trend, robust)
            low = _moving_mean(_moving_mean(_moving_mean(cycle, PERIOD), PERIOD), 3)
            seasonal = cycle[:, PERIOD : PERIOD + n] - _loess(low, LOW_PASS_SPAN, None)
            trend = _loess(y - seasonal, TREND_SPAN, robust)
        if outer < ROBUST_ROUNDS:
            miss = np.abs(y - seasonal - trend)
            ranked = np.sort(miss, axis=1)
            six_mad = 3.0 * (ranked[:, n // 2] + ranked[:, n - n // 2 - 1])[:, None]
            bisquare = (1 - (miss / np.where(six_mad > 0, six_mad, 1.0)) ** 2) ** 2
            robust = np.where(
                miss <= 0.001 * six_mad, 1.0, np.where(miss <= 0.999 * six_mad, bisquare, 0.0)
            )
    return seasonal, trend


_PARTS = T.StructType(
    [
        T.StructField("seasonal", T.ArrayType(T.DoubleType())),
        T.StructField("trend", T.ArrayType(T.DoubleType())),
    ]
)


@evaluated_once
@F.arrow_udf(_PARTS)
def seasonal_trend(series: pa.Array) -> pa.Array:
    """Seasonal and trend arrays; NULL for a NULL series or one of at most two seasons."""
    seasonal, trend = [], []
    for rows, y in by_length(series):
        if y.shape[1] > 2 * PERIOD:
            s, t = decompose(y)
            seasonal.append((rows, s))
            trend.append((rows, t))
    parts = [to_lists(p, len(series)) for p in (seasonal, trend)]
    return pa.StructArray.from_arrays(parts, ["seasonal", "trend"], mask=parts[0].is_null())
