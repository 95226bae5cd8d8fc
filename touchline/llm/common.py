"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds at once beside the batch Spark hands it.
SLICE_BYTES = 4 << 20

#: the C library's way to return freed memory to the system, where it has one
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _trim = None

#: odd multiplier of the 64-bit mixing steps (golden ratio)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * GOLDEN
    x = (x ^ (x >> np.uint64(29))) * GOLDEN
    return x ^ (x >> np.uint64(32))


_claimed: list = []


def claim(memo: dict | None) -> None:
    """Keeps in a Python worker the memo of the operator that runs in it, and gives back what others left there."""
    if _claimed and _claimed[0] is memo:
        return
    for other in _claimed:
        if other is not None:
            other.clear()
    _claimed[:] = [memo]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that column `text` of each cut holds about `limit` bytes; one long row stands alone."""
    column = batch.column(text)
    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def map_text(df: DataFrame, columns: list[str], each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies `each` to bounded cuts of the chosen columns.

    Every other column of df stays outside, but for those of `carry`, which
    follow the row that `each` makes of theirs.
    """
    own = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, text):
                made = each(cut.select(range(own)))
                for k in range(own, cut.num_columns):
                    made = made.append_column(carry[k - own], cut.column(k))
                yield made

    kinds = dict(df.dtypes)
    return df.select(*columns, *carry).mapInArrow(run, ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in carry)]))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of every row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def whole(text: str = "text"):
    """The text with null as the empty string."""
    return F.coalesce(F.col(text), F.lit("")).alias(text)


def shared_folder(spark: SparkSession) -> str:
    """URI of the checkpoint folder that driver and executors share; one of our own only where none is set, in local mode."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
