"""A log of pipeline runs as append-only tables, and a scope that writes to it."""

from __future__ import annotations

import datetime
import socket
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "run_id string, parent_run_id string, stage string, status string, at timestamp, rows_out long, exit_code int, error string, host string, extra map<string,string>"
ARTIFACT = "run_id string, direction string, kind string, path string, checksum string, at timestamp"


class LineageLog:
    """Appends events; what is true now is a view of the latest event of each run, so nothing is updated in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, name: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _now(self) -> datetime.datetime:
        return datetime.datetime.now(datetime.timezone.utc)

    def start(self, stage: str, parent: str | None = None, extra: dict[str, str] | None = None) -> str:
        run = uuid.uuid4().hex
        self._append("runs", RUN, run, parent, stage, "running", self._now(), None, None, None, socket.gethostname(), extra or {})
        return run

    def finish(self, run: str, status: str = "ok", rows_out: int | None = None, exit_code: int = 0, error: str | None = None) -> None:
        """Closes a run; a run that is closed stays as it is."""
        open_ = self.runs().filter((F.col("run_id") == run) & (F.col("status") == "running")).first()
        if open_ is not None:
            self._append("runs", RUN, run, open_.parent_run_id, open_.stage, status, self._now(), rows_out, exit_code, error, open_.host, open_.extra)

    def artifact(self, run: str, direction: str, kind: str, path: str, checksum: str | None = None) -> None:
        self._append("artifacts", ARTIFACT, run, direction, kind, path, checksum, self._now())

    def runs(self) -> DataFrame:
        """One row a run: its latest event, and when it started."""
        events = self.spark.read.schema(RUN).parquet(f"{self.folder}/runs")
        latest = Window.partitionBy("run_id").orderBy(F.col("at").desc(), (F.col("status") == "running").cast("int"))
        started = F.min("at").over(Window.partitionBy("run_id"))
        return events.withColumn("started_at", started).withColumn("_k", F.row_number().over(latest)).filter("_k = 1").drop("_k")

    def artifacts(self) -> DataFrame:
        return self.spark.read.schema(ARTIFACT).parquet(f"{self.folder}/artifacts")

    def edges(self) -> DataFrame:
        """(a, b): parent to child, and producer to consumer of one path."""
        runs, art = self.runs(), self.artifacts()
        parents = runs.filter("parent_run_id is not null").select(F.col("parent_run_id").alias("a"), F.col("run_id").alias("b"))
        made = art.filter("direction = 'out'").select("path", F.col("run_id").alias("a"))
        used = art.filter("direction = 'in'").select("path", F.col("run_id").alias("b"))
        return parents.union(made.join(used, "path").select("a", "b")).distinct()

    def barren(self) -> DataFrame:
        """Runs that made nothing."""
        return self.runs().join(self.artifacts().filter("direction = 'out'").select("run_id"), "run_id", "left_anti")

    @contextmanager
    def scope(self, stage: str, parent: str | None = None):
        """Starts a run and closes it as ok or, where the body raises, as failed."""
        run = self.start(stage, parent)
        try:
            yield run
        except Exception as e:
            self.finish(run, "fail", exit_code=1, error=f"{type(e).__name__}: {e}")
            raise
        self.finish(run)


def retain(df: DataFrame, at: str, now: str, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows by age; writing what is kept is left to the caller, so a dry run is to look at dropped."""
    old = F.col(at) < F.lit(now).cast(df.schema[at].dataType) - F.expr(f"interval {keep_days} days")
    return df.filter(~old), df.filter(old)
