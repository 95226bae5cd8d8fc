"""A provider's files as a data source: `spark.read.format("provider_seasons")`.

Files lie below `path`, a folder a season (`season=1997`). A file is a partition
of the scan, filters on the season choose files before any is opened, and what a
file has is given in the canonical columns of its kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .providers import CANONICAL


class ProviderError(ValueError):
    """A provider has nothing of what was asked for."""


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI, or of a folder of this machine."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (pa.fs.LocalFileSystem(), path)


@dataclass
class SeasonFile(InputPartition):
    season: str
    file: str


class ProviderSeasons(DataSource):
    """Options: path; kind (players, player_matches or teams); provider, its name; unknown, `empty` or `error` for seasons it does not have."""

    @classmethod
    def name(cls) -> str:
        return "provider_seasons"

    def schema(self) -> StructType:
        return CANONICAL[self.options.get("kind", "players")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return SeasonReader(schema, dict(self.options))


class SeasonReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.wanted, self.options, self.asked = schema, options, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of the season; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("season",):
                mine = {str(f.value)}
            elif isinstance(f, In) and f.attribute == ("season",):
                mine = set(map(str, f.value))
            else:
                yield f
                continue
            self.asked = mine if self.asked is None else self.asked & mine

    def partitions(self) -> list[SeasonFile]:
        system, root = opened(self.options["path"])
        found = []
        for entry in system.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            season = re.search(r"/season=([^/]+)/[^/._][^/]*\.parquet$", entry.path)
            if season and (self.asked is None or unquote(season[1]) in self.asked):
                found.append(SeasonFile(unquote(season[1]), entry.path))
        missing = (self.asked or set()) - {f.season for f in found}
        if missing and self.options.get("unknown", "empty") == "error":
            raise ProviderError(f"{self.options.get('provider', 'provider')} has no season {', '.join(sorted(missing))}")
        return found

    def read(self, partition: SeasonFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, SeasonFile):  # a scan without partitions is asked for once, with nothing
            return
        system, _ = opened(self.options["path"])
        target = to_arrow_schema(self.wanted)
        given = {"season": partition.season, "provider": self.options.get("provider", "provider")}
        with system.open_input_file(partition.file) as file:
            held = pq.ParquetFile(file)
            names = [f.name for f in target if f.name in held.schema_arrow.names]
            for batch in held.iter_batches(columns=names):
                column = lambda f, batch=batch: batch.column(f.name).cast(f.type) if f.name in names else pa.repeat(pa.scalar(given.get(f.name), f.type), batch.num_rows)
                yield pa.RecordBatch.from_arrays([column(f) for f in target], schema=target)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSeasons)


def read_seasons(spark: SparkSession, path: str, kind: str, provider: str, unknown: str = "empty") -> DataFrame:
    register(spark)
    return spark.read.format("provider_seasons").option("path", path).option("kind", kind).option("provider", provider).option("unknown", unknown).load()
