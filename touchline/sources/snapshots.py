"""Sealed copies of tables: Parquet and a manifest with the digest of every file, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows of a file of a snapshot
ROWS = 1_000_000


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the Parquet files below a folder, digested where they are read.

    A file is one value while it is digested, so snapshots are written in files
    of bounded rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    tail = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return found.select(tail.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(tables: dict[str, tuple[DataFrame, list[str]]], folder: str, force: bool = False) -> None:
    """Writes each table sorted by its keys, with sorted columns, beside a manifest, and moves the whole into place.

    A snapshot is never changed: if one is there, this fails, or with force the
    old one is moved aside first.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    target, system = _path(spark, folder)
    if system.exists(target):
        if not force:
            raise FileExistsError(folder)
        system.rename(target, _path(spark, f"{folder}.old-{uuid.uuid4().hex}")[0])
    staged = f"{folder}.new-{uuid.uuid4().hex}"
    for name, (df, keys) in tables.items():
        df.select(*sorted(df.columns)).sort(*keys).write.option("compression", "zstd").option("maxRecordsPerFile", ROWS).parquet(f"{staged}/{name}")
    _files(spark, staged).write.json(f"{staged}/manifest")
    system.rename(_path(spark, staged)[0], target)


def verify_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(file, error): files that are missing, not in the manifest, or of another size or digest; no row if all is well."""
    stated = spark.read.schema("file string, bytes long, sha256 string").json(f"{folder}/manifest").select("file", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    both = stated.join(_files(spark, folder), "file", "full")
    error = F.when(F.col("sha256").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "digest")
    return both.select("file", error.alias("error")).filter("error is not null")


def restore_snapshot(spark: SparkSession, folder: str, name: str, target: str, dry_run: bool = True) -> int:
    """Rows that the table has (and, unless it is a dry run, that now stand at target); a damaged snapshot is refused."""
    if not verify_snapshot(spark, folder).isEmpty():
        raise ValueError(f"{folder} is damaged")
    df = spark.read.parquet(f"{folder}/{name}")
    n = df.count()
    if not dry_run:
        df.write.mode("overwrite").parquet(target)
        if spark.read.parquet(target).count() != n:
            raise ValueError(f"{target} has other rows than {folder}/{name}")
    return n


def load_snapshot(spark: SparkSession, folder: str, name: str, schema: str, key: str) -> DataFrame:
    """A table of a snapshot as typed columns, sorted by its key; columns that it does not have are null."""
    stored = spark.read.parquet(f"{folder}/{name}")
    wanted = spark.createDataFrame([], schema).schema
    return stored.select(*[(F.col(f.name) if f.name in stored.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]).sort(key)
