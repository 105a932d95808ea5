"""Smoothed level of a structural series model, chosen from a grid of variance ratios.

The model is a local linear trend, plus a twelve-month season when the series is long enough,
with unknown start values. Differencing removes the start values, and what is left is a moving
average whose covariance is banded: its factor needs a fixed number of values per month. The
likelihood of all ratios, the smoothed errors and the level are recursions over the months, for all
series of a batch at once, so time and memory grow in proportion to the length of a series.
"""

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.batches import by_length, evaluated_once, to_lists

# --- fixed values: season length and variance ratios to the irregular component --------------
PERIOD = 12
LEVEL_RATIOS = [0.0, 0.01, 0.1, 1.0, 10.0]
SLOPE_RATIOS = [0.0, 0.001, 0.01, 0.1]
SEASON_RATIOS = [0.0, 0.01, 0.1]

#: Series worked on at once; bounds the memory of a batch of equal lengths.
ROWS = 1024


def _polynomials(seasonal: bool) -> tuple[np.ndarray, ...]:
    """Differencing of the series, and what it leaves of level, slope and season noise."""
    step = np.array([1.0, -1.0])
    year = np.ones(PERIOD) if seasonal else np.ones(1)
    twice = np.convolve(step, step)
    return np.convolve(twice, year), np.convolve(step, year), year, twice


def _covariance(seasonal: bool) -> np.ndarray:
    """Autocovariances of the differenced series, one row per grid point."""
    noises = _polynomials(seasonal)
    band = len(noises[0])
    lags = []
    for p in noises:
        own = np.correlate(p, p, "full")[len(p) - 1 :]
        lags.append(np.pad(own, (0, band - len(own))))
    seasons = SEASON_RATIOS if seasonal else [0.0]
    return np.array([
        lags[0] + ql * lags[1] + qs * lags[2] + qw * lags[3]
        for ql, qs, qw in product(LEVEL_RATIOS, SLOPE_RATIOS, seasons)
    ])


def _factor(covariance: np.ndarray, m: int) -> np.ndarray:
    """Banded Cholesky factors: ``out[t, g, k]`` is entry (t, t - k) for grid point g."""
    grid, band = covariance.shape
    out = np.zeros((m, grid, band))
    for t in range(m):
        for k in range(min(t, band - 1), -1, -1):
            # Entries of row t left of column t - k that row t - k has, too.
            far = min(t, band - 1)
            shared = np.arange(k + 1, far + 1)
            total = covariance[:, k] - (out[t][:, shared] * out[t - k][:, shared - k]).sum(axis=1)
            out[t, :, k] = np.sqrt(total) if k == 0 else total / out[t - k, :, 0]
    return out


def _likelihood(factor: np.ndarray, z: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Restricted log-likelihood, up to a constant, per series and grid point."""
    m, grid, band = factor.shape
    recent = np.zeros((len(z), grid, band - 1))
    squares = np.zeros((len(z), grid))
    for t in range(m):
        now = (z[:, t, None] - (recent * factor[t, :, 1:]).sum(axis=2)) / factor[t, :, 0]
        squares += now**2
        recent = np.concatenate([now[:, :, None], recent[:, :, :-1]], axis=2)
    logdet = 2 * np.log(factor[:, :, 0]).sum(axis=0)
    return -(m * np.log(np.maximum(squares, floor[:, None]) / m) + logdet) / 2


def _solve(factor: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Covariance inverse times ``z``; ``factor[t, s, k]`` belongs to series s."""
    m, _, band = factor.shape
    half = np.zeros((m + band, len(z)))
    for t in range(m):
        before = half[t : t + band - 1][::-1].T
        half[t + band - 1] = (z[:, t] - (before * factor[t, :, 1:]).sum(axis=1)) / factor[t, :, 0]
    half = half[band - 1 : -1]
    out = np.zeros((m + band, len(z)))
    diagonals = np.zeros((m + band, len(z), band))
    diagonals[:m] = factor
    for t in range(m - 1, -1, -1):
        after = sum(diagonals[t + k, :, k] * out[t + k] for k in range(1, band))
        out[t] = (half[t] - after) / factor[t, :, 0]
    return out[:m].T


def _walk(x: np.ndarray) -> np.ndarray:
    """Sum of all earlier values."""
    return np.cumsum(x, axis=1) - x


def _walk_back(x: np.ndarray) -> np.ndarray:
    return _walk(x[:, ::-1])[:, ::-1]


def _pulse(x: np.ndarray) -> np.ndarray:
    """Effect of season noise on the months after it."""
    out = np.zeros_like(x)
    for t in range(1, x.shape[1]):
        out[:, t] = x[:, t - 1]
        if t > 1:
            out[:, t] -= x[:, t - 2]
        if t >= PERIOD:
            out[:, t] += out[:, t - PERIOD]
    return out


def _levels(y: np.ndarray, errors: np.ndarray, ratios: np.ndarray, seasonal: bool) -> np.ndarray:
    """Level of each series from its smoothed errors (series less everything the model explains)."""
    n = y.shape[1]
    ql, qs, qw = ratios.T[:, :, None]
    trend = ql * _walk(_walk_back(errors)) + qs * _walk(_walk(_walk_back(_walk_back(errors))))
    rest = y - errors - trend
    t = np.arange(n) / n
    line = np.column_stack([np.ones(n), t])
    design = line
    if seasonal:
        rest = rest - qw * _pulse(_pulse(errors[:, ::-1])[:, ::-1])
        month = np.eye(PERIOD)[np.arange(n) % PERIOD]
        design = np.column_stack([line, month[:, :-1] - month[:, -1:]])
    start = np.linalg.lstsq(design, rest.T, rcond=None)[0]
    return (line @ start[:2]).T + trend


def _smoothed(y: np.ndarray, factor: np.ndarray, seasonal: bool) -> np.ndarray:
    """Levels of at most ``ROWS`` series."""
    differencing = _polynomials(seasonal)[0]
    band, m = len(differencing), len(factor)
    z = sum(c * y[:, band - 1 - k : band - 1 - k + m] for k, c in enumerate(differencing))
    tiny = 1e-12 * np.maximum((y**2).sum(axis=1), 1e-300)
    # One value beyond the start values is equally likely under all ratios.
    best = _likelihood(factor, z, tiny).argmax(axis=1) if m > 1 else np.zeros(len(y), dtype=int)
    weights = _solve(factor[:, best], z)
    errors = np.zeros_like(y)
    for k, c in enumerate(differencing):
        errors[:, band - 1 - k : band - 1 - k + m] += c * weights
    seasons = SEASON_RATIOS if seasonal else [0.0]
    ratios = np.array(list(product(LEVEL_RATIOS, SLOPE_RATIOS, seasons)))[best]
    return _levels(y, errors, ratios, seasonal)


def smoothed_level(y: np.ndarray) -> np.ndarray:
    """Level of each complete row of ``y`` at its best grid point (restricted likelihood)."""
    n = y.shape[1]
    seasonal = n > 2 * PERIOD
    spare = n - (2 + (PERIOD - 1 if seasonal else 0))
    if spare < 1 or not len(y):
        return y.copy()
    factor = _factor(_covariance(seasonal), spare)
    parts = [_smoothed(y[i : i + ROWS], factor, seasonal) for i in range(0, len(y), ROWS)]
    return np.concatenate(parts)


@evaluated_once
@F.arrow_udf(T.ArrayType(T.DoubleType()))
def structural_level(series: pa.Array) -> pa.Array:
    """Smoothed level per series; NULL for NULL."""
    return to_lists([(rows, smoothed_level(y)) for rows, y in by_length(series)], len(series))
