"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame, vector_col: str, *more: Column) -> DataFrame:
    """Column v, the vector as doubles, and columns more, of the rows whose vector is there and holds neither nulls nor non-finite entries."""
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"), *more).filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix of so many columns (None: of the longest list), zeros at the end of shorter lists."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    width = int(sizes.max(initial=0)) if dims is None else dims
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out
