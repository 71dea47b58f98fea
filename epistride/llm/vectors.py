"""Vector columns: rows that can take part, as fixed-width binary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vector: str):
    """Not null, not empty, all components finite numbers."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def width_of(rows: DataFrame, vector: str) -> int:
    """Components of the longest vector; shorter ones count as followed by zeros."""
    return rows.agg(F.max(F.size(vector)).alias("n")).first().n or 0


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Doubles of a list column without nulls, one row per list, filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), width))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; they are scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))
