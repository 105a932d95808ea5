"""Least squares for any number of factors: one design matrix per row, solved in stacks."""

from functools import lru_cache
from math import atan, cos, pi, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.batches import by_length, evaluated_once, to_lists


@lru_cache(maxsize=None)
def t_975(dof: int) -> float:
    """97.5% quantile of Student's t for a whole number of degrees of freedom.

    Bisection on the finite series of the two-sided probability.
    """

    def inside(t: float) -> float:
        theta = atan(t / sqrt(dof))
        c2 = cos(theta) ** 2
        if dof % 2:
            term, total = cos(theta), 0.0
            for k in range(1, (dof - 1) // 2 + 1):
                total += term
                term *= c2 * 2 * k / (2 * k + 1)
            return (theta + sin(theta) * total) * 2 / pi
        term, total = 1.0, 0.0
        for k in range(1, dof // 2 + 1):
            total += term
            term *= c2 * (2 * k - 1) / (2 * k)
        return sin(theta) * total

    low, high = 1.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < 0.95 else (low, mid)
    return (low + high) / 2


def solve_stack(x: np.ndarray, y: np.ndarray):
    """(minimum-norm beta, pseudo-inverse of X'X, residual sum of squares) for stacked designs."""
    n, p = x.shape[1:]
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    keep = s > np.finfo(float).eps * max(n, p) * s[:, :1]
    inverse = np.where(keep, 1 / np.where(keep, s, 1.0), 0.0)
    beta = np.einsum("mkp,mk,mnk,mn->mp", vt, inverse, u, y, optimize=True)
    # Cutoff of a pseudo-inverse of X'X, taken on the squared singular values of X itself.
    squared = np.where(s**2 > 1e-15 * s[:, :1] ** 2, s, 0.0)
    weight = np.where(squared > 0, 1 / np.where(squared > 0, squared, 1.0) ** 2, 0.0)
    gram = np.einsum("mkp,mk,mkq->mpq", vt, weight, vt)
    sse = ((y - np.einsum("mnp,mp->mn", x, beta)) ** 2).sum(axis=1)
    return beta, gram, sse


_SOLUTION = T.StructType(
    [
        T.StructField("beta", T.ArrayType(T.DoubleType())),
        T.StructField("gram_inverse", T.ArrayType(T.DoubleType())),
        T.StructField("sigma2", T.DoubleType()),
        T.StructField("dof", T.IntegerType()),
        T.StructField("t_crit", T.DoubleType()),
    ]
)


@evaluated_once
@F.arrow_udf(_SOLUTION)
def ols_solve(y: pa.Array, x: pa.Array) -> pa.Array:
    """Fit each row: ``x`` is the design flattened row by row, intercept column included."""
    size = len(y)
    betas, grams = [], []
    sigma2, dof, t_crit = np.zeros(size), np.zeros(size, dtype=np.int32), np.zeros(size)
    x_length = np.asarray(x.value_lengths().fill_null(0), dtype=np.int64)
    x_start = np.concatenate([[0], np.cumsum(x_length)[:-1]]) if size else x_length
    x_flat = x.flatten().to_numpy(zero_copy_only=False)
    for rows, target in by_length(y):
        n = target.shape[1]
        widths = x_length[rows] // n
        for p in np.unique(widths[widths > 0]):
            pick = widths == p
            at = x_start[rows[pick]][:, None] + np.arange(n * p)
            beta, gram, sse = solve_stack(x_flat[at].reshape(-1, n, p), target[pick])
            free = max(n - int(p), 1)
            betas.append((rows[pick], beta))
            grams.append((rows[pick], gram.reshape(-1, p * p)))
            sigma2[rows[pick]] = sse / free
            dof[rows[pick]] = free
            t_crit[rows[pick]] = t_975(free)
    beta = to_lists(betas, size)
    return pa.StructArray.from_arrays(
        [beta, to_lists(grams, size), pa.array(sigma2), pa.array(dof), pa.array(t_crit)],
        ["beta", "gram_inverse", "sigma2", "dof", "t_crit"],
        mask=beta.is_null(),
    )
