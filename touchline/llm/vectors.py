"""Vector columns as whole-number matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: components beyond this after scaling are refused, as sums of their products would leave 64 bits
LARGEST = 1 << 27


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def usable(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    number = F.col(vector).cast("array<double>")
    return F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(column: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector; short vectors are filled up with zeros."""
    made = np.zeros((len(column), width), dtype=np.int64)
    if not len(column):
        return made
    values = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64))
    if len(values) and not np.abs(values).max() <= LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    made[np.arange(width) < lengths[:, None]] = values.astype(np.int64)
    return made


def rows_of(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column of whole numbers, all of one width, as a matrix."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def list_of(matrix: np.ndarray) -> pa.ListArray:
    """A matrix of whole numbers as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), type=pa.int64()))
