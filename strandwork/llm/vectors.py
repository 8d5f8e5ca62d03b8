"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: str) -> Column:
    """True for vectors that are not null, hold no null or non-finite component and are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dtype_of(df: DataFrame, vector: str) -> np.dtype:
    """Four bytes a component hold what came as float, eight what came as anything else."""
    return np.dtype("<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of dim numbers as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unpacked(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)


def common_dim(df: DataFrame, vector: str) -> int:
    """The most frequent dimension, the larger of two as frequent; 0 without vectors."""
    row = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row["d"] if row else 0


def sample(df: DataFrame, vector: str, key: str, rows: int) -> np.ndarray:
    """A bounded sample of vectors, the same for the same table: the rows with the smallest hash of their key."""
    got = df.select(vector, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(rows).select(vector).collect()
    return np.array([r[0] for r in got], np.float64)
