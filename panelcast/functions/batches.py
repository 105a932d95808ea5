"""Moving Arrow list columns in and out of numpy, one matrix per series length."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


_ROWS_AT_ONCE = 512  # bounds the work arrays, whatever the Arrow batch size


def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (row numbers, matrix) for the non-NULL lists of each length above zero."""
    lengths = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for n in np.unique(lengths[lengths > 0]):
        same = np.flatnonzero(lengths == n)
        for at in range(0, len(same), _ROWS_AT_ONCE):
            rows = same[at : at + _ROWS_AT_ONCE]
            yield rows, flat[starts[rows][:, None] + np.arange(n)].astype(float)


def to_lists(parts: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.Array:
    """Reassemble per-length matrices into one list column; uncovered rows are NULL."""
    lengths = np.zeros(size, dtype=np.int64)
    covered = np.zeros(size, dtype=bool)
    for rows, values in parts:
        lengths[rows] = values.shape[1]
        covered[rows] = True
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(offsets[-1])
    for rows, values in parts:
        flat[offsets[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(~covered)
    )


def evaluated_once(udf):
    """Keep the optimizer from copying a Python call into every expression that uses its result.

    Calls of a deterministic function count as free to copy, and a chain of them multiplies.
    """
    return udf.asNondeterministic()
