"""Exact nearest rows of tiles of vectors, as arrays: rough distances by a matrix product, exact ones where they matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Ranking distances of queries x to rows y: squared L2, or 1 - cosine (rows of norm 0 have none)."""
    if metric == "cosine":
        norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None]
        return 1 - (x @ y.T) / np.where(norms > 0, norms, np.nan)
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The same for rows of x and y taken together, free of cancellation."""
    if metric == "cosine":
        return 1 - np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return ((x - y) ** 2).sum(1)


def numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an array column have ``dim`` values without nulls, and those vectors, from the Arrow buffers."""
    flat = column.flatten()
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    holes = np.zeros(len(column), dtype=bool)
    if flat.null_count:
        row = np.repeat(np.arange(len(column)), sizes)
        holes[row[~flat.is_valid().to_numpy(zero_copy_only=False)]] = True
    good = column.is_valid().to_numpy(zero_copy_only=False) & (sizes == dim) & ~holes
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = (offsets - offsets[0])[:-1][good]
    return good, values[starts[:, None] + np.arange(dim)] if len(starts) else np.zeros((0, dim))


def names(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers or as bytes, which sort as their strings do."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().astype(np.int64)
    return np.array(column.cast(pa.binary()).to_pylist(), dtype="S")


def arrow_names(ids: np.ndarray) -> pa.Array:
    """Ids as an Arrow column again."""
    return pa.array(ids) if ids.dtype.kind == "i" else pa.array(ids.tolist(), pa.binary()).cast(pa.string())


def first_k(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, distance, id) the k least of each query, by distance, then id; sorted by query."""
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], d[rank < k], ids[rank < k]


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, metric: str, reach: np.ndarray | None = None, tile: int = 1024):
    """The k nearest rows y (with ids) of each query x: (query, distance, id), within ``reach`` of each query if given.

    ``tile`` rows and queries are compared at once.
    """
    found = np.zeros(0, np.int64), np.zeros(0), ids[:0]
    for at in range(0, len(y), tile):
        part = y[at : at + tile]
        for first in range(0, len(x), tile):
            own = x[first : first + tile]
            rough = distances(own, part, metric)
            k_ = min(k, len(part)) - 1
            limit = np.partition(rough, k_, axis=1)[:, k_]
            if reach is not None:
                limit = np.minimum(limit, reach[first : first + tile])
            i, j = np.nonzero(rough <= (limit + 1e-6 * (1 + np.abs(limit)))[:, None])
            new = i + first, exact(own[i], part[j], metric), ids[at + j]
            found = first_k(*(np.concatenate(z) for z in zip(found, new, strict=True)), k)
    return found
