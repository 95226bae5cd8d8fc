"""Results that several later steps read, written once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session's setting; one of our own only where none is set, in local mode."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="touchline-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table; what reads it starts from the files and knows their size.

    Unlike a checkpoint, what is read back carries no constraints of the plan
    that made it, which pile up where results follow from results. Columns
    without a type, or with the same name twice, cannot be in such a table, so
    those frames are checkpointed. What is written already is not written again.
    """
    if written(df):
        return df
    spark = df.sparkSession
    folder = shared_folder(spark)
    if len(set(map(str.lower, df.columns))) < len(df.columns) or any("void" in kind for _, kind in df.dtypes):
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4()}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = True
    return made


def written(df: DataFrame) -> bool:
    """Whether df is what cut has given, unchanged."""
    return "_written" in df.__dict__


_kept: dict = {}


def kept(spark: SparkSession, name: tuple, make) -> DataFrame:
    """The rows of make(), written the first time a session asks for this name and read after that."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _kept:
        for other in [k for k in _kept if k[0] != key[0]]:
            del _kept[other]
        _kept[key] = cut(make())
    return _kept[key]
