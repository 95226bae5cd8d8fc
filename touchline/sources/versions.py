"""Tables whose repairs take effect as a whole or not at all: staged, measured while written, and then pointed at."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Repair:
    """What a repair did, or would do: rows before and after, rows that differ, rows that break each guard, and the version made, if any."""

    rows_in: int
    rows_out: int
    added: int
    removed: int
    changed: int
    broken: dict
    version: int | None


class VersionedTable:
    """Versions of a table below a folder. A version is a number, a marker file that says where its rows lie, and those rows.

    The last marker is the current version. A marker is made by exclusive
    creation, so of two repairs of one version only one comes through, and a
    reader sees the old rows or the new ones. Older versions stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, system = self._path("versions")
        return sorted(int(s.getPath().getName()) for s in system.listStatus(path)) if system.exists(path) else []

    def _rows_of(self, version: int) -> str:
        return self.spark.read.text(f"{self.folder}/versions/{version:08d}").first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{self.folder} has no version {version or ''}")
        return self.spark.read.parquet(f"{self.folder}/{self._rows_of(version or found[-1])}")

    def _point(self, version: int, rows: str) -> None:
        path, system = self._path("versions", f"{version:08d}")
        out = system.create(path, False)  # fails if somebody else has made this version
        try:
            out.write(bytearray(f"{rows}\n", "utf-8"))
        finally:
            out.close()

    def difference(self, before: DataFrame, after: DataFrame) -> tuple[int, int, int]:
        """Rows added, removed and changed, by the keys."""
        rest = [c for c in before.columns if c not in self.keys]
        sealed = lambda df, out: df.select(*self.keys, F.struct(*rest).alias(out))
        a, b = sealed(before, "_a"), sealed(after.select(*before.columns), "_b")
        names = {c: f"_of{k}" for k, c in enumerate(self.keys)}
        right = b.withColumnsRenamed(names)
        both = a.join(right, reduce(Column.__and__, [a[c].eqNullSafe(right[n]) for c, n in names.items()]), "full")
        old, new = F.col("_a").isNotNull(), F.col("_b").isNotNull()
        row = both.agg(F.count_if(~old).alias("added"), F.count_if(~new).alias("removed"), F.count_if(old & new & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed")).first()
        return row["added"], row["removed"], row["changed"]

    def create(self, df: DataFrame) -> None:
        rows = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{rows}")
        self._point(1, rows)

    def repair(self, df: DataFrame, guards: dict[str, Column] | None = None, dry_run: bool = True) -> Repair:
        """Makes df the next version if no row breaks a guard (a condition that every row has to meet; null breaks it).

        A dry run writes nothing. Else the rows are written beside the current
        ones; how many there are and how many break each guard is measured by
        that write, and measured again on what was written should tasks that ran
        twice have been counted twice. Where a guard is broken the current
        version stays, and what was staged is taken away.
        """
        found = self.versions()
        before = self.read()
        broken = {name: F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in (guards or {}).items()}
        measures = [F.count(F.lit(1)).alias("_rows"), *broken.values()]
        if dry_run:
            told, after = df.agg(*measures).first().asDict(), df
        else:
            rows, seen = f"rows-{uuid.uuid4().hex}", Observation()
            df.observe(seen, *measures).write.parquet(f"{self.folder}/{rows}")
            told, after = seen.get, self.spark.read.parquet(f"{self.folder}/{rows}")
            if told["_rows"] != after.count():
                told = after.agg(*measures).first().asDict()
        added, removed, changed = self.difference(before, after)
        wrong = {name: told[name] for name in broken}
        version = None
        if not dry_run and not any(wrong.values()):
            version = found[-1] + 1
            self._point(version, rows)
        elif not dry_run:
            path, system = self._path(rows)
            system.delete(path, True)
        return Repair(before.count(), told["_rows"], added, removed, changed, wrong, version)

    def back_to(self, version: int) -> int:
        """Makes an older version the current one, as a version of its own."""
        if version not in self.versions():
            raise FileNotFoundError(f"{self.folder} has no version {version}")
        last = self.versions()[-1] + 1
        self._point(last, self._rows_of(version))
        return last
