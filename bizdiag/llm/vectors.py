"""Vectors in Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector exists, has components, and all are finite."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    return F.coalesce((F.size(vector) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def numbers(docs: DataFrame, vector: str) -> np.dtype:
    """The type in which components are sent: single precision stays single."""
    return np.dtype("<f4" if docs.schema[vector].dataType.elementType.typeName() == "float" else "<f8")


def matrix(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """Rows of doubles from a binary column; all of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
