"""Optimal string alignment distance, vectorised over pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = words.str.len().to_numpy(dtype=np.int64)
    out = np.full((len(words), int(sizes.max(initial=0))), -1, dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<i4")
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def alignment_distances(a: pd.Series, b: pd.Series, most: int) -> np.ndarray:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice; most + 1 stands for more.

    One table cell is computed for all pairs at a time; only the diagonals within `most` can matter.
    """
    x, nx = _codes(a)
    y, ny = _codes(b)
    far, n = most + 1, len(a)
    width = y.shape[1]
    before = np.full((n, width + 1), far, np.int16)
    row = np.minimum(np.arange(width + 1), far).astype(np.int16)[None, :].repeat(n, axis=0)
    out = np.full(n, far, np.int16)
    out[nx == 0] = np.minimum(ny[nx == 0], far)
    for i in range(1, x.shape[1] + 1):
        new = np.full((n, width + 1), far, np.int16)
        new[:, 0] = min(i, far)
        for j in range(max(1, i - most), min(width, i + most) + 1):
            value = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                value = np.where(swap, np.minimum(value, before[:, j - 2] + 1), value)
            new[:, j] = np.minimum(value, far)
        ends = nx == i
        out[ends] = new[ends, ny[ends]]
        before, row = row, new
    return np.minimum(out, far).astype(np.int32)


def alignment_distance(a: Column, b: Column, most: int = 2) -> Column:
    """The distance of two string columns, at most `most` + 1; null if either is null."""

    @F.pandas_udf("int")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        known = left.notna() & right.notna()
        out = pd.Series([None] * len(left), dtype="Int32")
        if known.any():
            out[known] = alignment_distances(left[known].reset_index(drop=True), right[known].reset_index(drop=True), most)
        return out

    return distance(a, b)
