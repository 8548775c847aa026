"""Embeddings packed into blocks of rows, for tiled comparison and for sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null or non-finite components, v as doubles."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)


def matrix(values: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; a shorter vector is continued with zeros."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def shape(vectors: DataFrame) -> tuple[int, int]:
    """(rows, the longest vector's length)."""
    row = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    return int(row[0]), int(row[1])
