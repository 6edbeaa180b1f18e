"""Vector arithmetic on numpy blocks, as used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Valid list entries of one length as a double matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of x to all rows of c, never negative."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    return np.maximum(d, 0)


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 2_048) -> np.ndarray:
    """The nearest row of c for each row of x; of equally near ones the first.

    Rows whose best two are as close as the expansion's rounding are compared again by differences.
    """
    out = np.empty(len(x), dtype=np.int64)
    for s in range(0, len(x), rows):
        part = x[s : s + rows]
        d = distances(part, c)
        best = d.argmin(axis=1)
        if len(c) > 1:
            two = np.partition(d, 1, axis=1)[:, :2]
            scale = (part * part).sum(1) + (c * c).sum(1).max()
            for i in np.flatnonzero(two[:, 1] - two[:, 0] <= 1e-9 * (scale + 1)):
                best[i] = ((part[i] - c) ** 2).sum(1).argmin()
        out[s : s + rows] = best
    return out


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, exact distance) of the k nearest rows of x to each query by (distance, id), query by query.

    Candidates come from one product per stretch of queries; all that rounding may have put behind the k-th are compared
    again by differences.
    """
    parts = []
    x2 = (x * x).sum(1)
    for s in range(0, len(q), step := max(1, cells // max(1, len(x)))):
        part = q[s : s + step]
        d = (part * part).sum(1)[:, None] - 2 * (part @ x.T) + x2[None]
        if len(x) > k:
            slack = 1e-9 * ((part * part).sum(1) + x2.max() + 1)
            qi, xi = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        else:
            qi, xi = (a.ravel() for a in np.indices(d.shape))
        exact = ((part[qi] - x[xi]) ** 2).sum(1)
        order = np.lexsort((ids[xi], exact, qi))
        qi, xi, exact = qi[order], xi[order], exact[order]
        starts = np.searchsorted(qi, np.arange(len(part)))
        keep = np.arange(len(qi)) - starts[qi] < k
        parts.append((qi[keep] + s, xi[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
