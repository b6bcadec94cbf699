"""What the vector operators share: reading embeddings, and the test of what takes part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(column: str = "embedding"):
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    n = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, dim if n == 0 and dim else (len(flat) // n if n else 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_dimension(df: DataFrame) -> DataFrame:
    """df with dim, the vector's length: only vectors of one length are compared."""
    return df.withColumn("dim", F.size("embedding"))
