"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def scaled(rows: DataFrame, scale: float, vector_col: str, limit: int, **keep: str) -> tuple[DataFrame, int, int]:
    """(x, keep...), the vectors' dimensions, and their number: rows whose vector is finite, each entry c as floor(scale * c), held to within the limit.

    The dimensions are the most frequent length, ties to the longer one; a vector of another length lacks entries or has too many, and its row is dropped like one with a null entry."""
    good = rows.filter(finite(rows[vector_col]))
    lengths = good.groupBy(F.size(rows[vector_col]).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dims, n = (lengths[0]["size"], lengths[0]["count"]) if lengths else (0, 0)
    whole = lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(limit)), F.lit(-limit)).cast("long")
    kept = good.filter(F.size(rows[vector_col]) == dims)
    return kept.select(*[rows[c].alias(name) for name, c in keep.items()], F.transform(rows[vector_col], whole).alias("x")), dims, n


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of equally long lists of whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def most(*arrays: np.ndarray) -> int:
    """The largest absolute value, as a Python number."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)
