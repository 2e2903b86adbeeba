"""What the operators on embeddings share: valid vectors as fixed-size binary rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from nearspan.shipping import ship


def matrix(payload: bytes | pa.Buffer, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(payload, kind).reshape(-1, dims)


def column_matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Rows of an Arrow list column without nulls, as a matrix."""
    if not len(column):
        return np.zeros((0, dims), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that large components don't overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, str]:
    """(id, v) of the vectors that take part, their length, and their numpy kind.

    Null, empty and zero vectors, those with null or non-finite components, and those of another length than most
    (of equally many: the longest) take no part, nor do null ids.
    """
    ship(vectors.sparkSession)
    kind = "<f8" if vectors.schema[vector_col].dataType == ArrayType(DoubleType(), vectors.schema[vector_col].dataType.containsNull) else "<f4"
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    found = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~odd).where(some).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    first = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = first["d"] if first else 0
    return found.where(F.size("v") == dims), dims, kind
