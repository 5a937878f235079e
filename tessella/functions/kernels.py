"""NumPy kernels that run on Arrow batches inside Spark tasks.

Each kernel sees one batch at a time; model parameters travel in the closure and
are K x D numbers, never data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as an (n, D) float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """The inverse: one float64 list per row."""
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def sparsemax_rows(x: np.ndarray) -> np.ndarray:
    desc = -np.sort(-x, axis=1)
    excess = np.cumsum(desc, axis=1) - 1.0
    size = np.arange(1, x.shape[1] + 1)
    support = (desc * size > excess).sum(axis=1)
    cut = excess[np.arange(len(x)), support - 1] / support
    return np.maximum(x - cut[:, None], 0.0)


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def energy_rows(s: np.ndarray, temperature: float) -> np.ndarray:
    top = s.max(axis=1)
    return -(top + temperature * np.log(np.exp((s - top[:, None]) / temperature).sum(axis=1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
