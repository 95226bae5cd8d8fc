"""Keyed state with timers: rounds that close, each told once and then forgotten."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "stage string, day date, n long, failures long, closing timestamp, due timestamp"


class Closing(StatefulProcessor):
    """Holds the counts, last time and timer of one (stage, day); tells them when the timer fires, and drops them."""

    def __init__(self, hours: int):
        self.wait = hours * 3600 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, failures long, closing long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        n, failures, closing, timer = self.held.get() if self.held.exists() else (0, 0, None, None)
        for row in rows:
            n, failures = n + row.n, failures + row.failures
            closing = row.at if closing is None else max(closing, row.at)
        due = self.due(key[1], closing)
        at = -(-due // 1000)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.held.update((n, failures, closing, at))
        return iter(())

    def due(self, day: datetime.date, closing: int) -> int:
        """Microseconds when a round is due: when its day is over, and the hours after its last event."""
        ends = (day - datetime.date(1970, 1, 1)).days + 1
        return max(ends * 86_400_000_000, closing + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, failures, closing, _ = self.held.get()
        self.held.clear()
        start, tick = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc), datetime.timedelta(microseconds=1)
        yield Row(stage=key[0], day=key[1], n=n, failures=failures, closing=start + closing * tick, due=start + self.due(key[1], closing) * tick)

    def close(self) -> None:
        pass


def closed_rounds(events: DataFrame, late: str = "1 day", hours: int = 2, step: str = "10 minutes") -> DataFrame:
    """(stage, day, n, failures, closing, due): each round of a stage's day once, when it is due by the watermark.

    A round is due when its day (UTC) is over and the hours since its last event
    have passed. Until then its state is four numbers; then it is told and
    dropped. Events later than `late` behind the newest are left out (if their
    step is closed), so a round told is never told again. Events are counted by
    steps before they meet, so a frequent stage sends few rows to its key; a step
    has to divide a day. Rows without a time are left out; those without a stage
    have one in common. Needs the RocksDB state store (see `timers`).
    """
    rows = events.filter("ts is not null").withWatermark("ts", late)
    steps = rows.groupBy(F.window("ts", step), F.col("event_type").alias("stage"))
    steps = steps.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max(F.unix_micros("ts")).alias("at"))
    steps = steps.select(F.window_time("window").alias("ts"), "stage", F.to_date("window.start").alias("day"), "n", "failures", "at")
    return steps.groupBy("stage", "day").transformWithState(Closing(hours), CLOSED, "Append", "EventTime")


def timers(spark: SparkSession) -> SparkSession:
    """A session like this one with the state store that keyed state needs; the given session stays as it is."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def sliding_counts(events: DataFrame, length: str = "14 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(stage, start, n, failures, total) of closed windows that begin each step.

    Days are counted first and the days' counts are put into windows, so an
    event is one state update, not one for each window that it is in.
    """
    daily = events.withWatermark("ts", late).groupBy(F.window("ts", step), F.col("event_type").alias("stage"))
    daily = daily.agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    daily = daily.select("stage", F.window_time("window").alias("ts"), "n", "failures", "total")
    wide = daily.groupBy(F.window("ts", length, step), "stage").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum("total").cast("double").alias("total"))
    return wide.select("stage", F.col("window.start").alias("start"), "n", "failures", "total")
