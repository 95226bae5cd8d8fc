"""Facts as a table that is partitioned by season and bucketed by a key.

One season is one folder, so reading a season reads no other, and a write takes
the place of the seasons it has rows of and of no other. Inside, rows lie in
buckets of the key, so joins and groupings on it need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.cuts import cut, shared_folder


class FactStore:
    """A table of facts. `season` parts it, `bucket` spreads it, `keys` name a fact inside its season."""

    def __init__(self, spark: SparkSession, name: str, season: str, bucket: str, keys: list[str], buckets: int = 16):
        self.spark, self.name, self.season, self.bucket, self.keys, self.buckets = spark, name, season, bucket, keys, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def upsert(self, changes: DataFrame) -> None:
        """Changes take the place of facts with their keys in their seasons, and are added where there are none.

        Only the seasons of the changes are read and written. Each is written
        beside the old one and takes its place when the job commits, so to do it
        twice gives the same table. Changes may not name a fact twice. Rows
        without a season are refused.
        """
        rows = cut(changes)
        if rows.filter(F.col(self.season).isNull()).limit(1).count():
            raise ValueError(f"facts without a {self.season}")
        if rows.groupBy(self.season, *self.keys).count().filter("count > 1").limit(1).count():
            raise ValueError("changes name a fact more than once")
        if not self.exists():
            order = [c for c in rows.columns if c != self.season]
            write = rows.select(*order, self.season).repartition(self.buckets, self.bucket).write.partitionBy(self.season).bucketBy(self.buckets, self.bucket).sortBy(self.bucket)
            write.option("path", f"{shared_folder(self.spark)}/{self.name}").option("partitionOverwriteMode", "dynamic").format("parquet").saveAsTable(self.name)
            return
        old = self.table()
        touched = [r[0] for r in rows.select(self.season).distinct().collect()]  # seasons, not facts
        kept = old.filter(F.col(self.season).isin(touched)).join(rows, [self.season, *self.keys], "left_anti")
        new = cut(kept.select(*old.columns).unionByName(rows.select(*old.columns)))
        new.repartition(self.buckets, self.bucket).write.insertInto(self.name, overwrite=True)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def of(self, *seasons) -> DataFrame:
        """The facts of some seasons, which are all that is read."""
        return self.table().filter(F.col(self.season).isin(*seasons))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
