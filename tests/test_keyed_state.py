"""Keyed state with timers and sliding windows over arriving files, late rows among them."""

import datetime

from touchline.streaming import keyed, monitor

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def arrive(spark, folder, rows):
    """One file more; rows are (hours since the start, stage)."""
    made = [(k, BASE + datetime.timedelta(hours=h), 1, stage, 2.0, "{}") for k, (h, stage) in enumerate(rows)]
    spark.createDataFrame(made, monitor.EVENT).coalesce(1).write.mode("append").parquet(folder)


def days(spark, folder):
    return sorted((r["stage"] or "", r["day"].day, r["n"], r["failures"]) for r in spark.read.parquet(folder).collect())


def test_each_round_is_told_once_and_late_rows_change_nothing(spark, tmp_path):
    own = keyed.timers(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != keyed.ROCKS
    folders = [str(tmp_path / k) for k in ("in", "out", "checkpoint")]

    def drain():
        monitor.drain(keyed.closed_rounds(monitor.read_events(own, folders[0])), folders[1], folders[2])

    arrive(own, folders[0], [(1, "view"), (5, "view"), (9, "error"), (20, None), (23.5, "view"), (30, "view")])
    drain()
    assert days(spark, folders[1]) == []
    arrive(own, folders[0], [(49.4, "view")])
    drain()
    assert days(spark, folders[1]) == [("", 1, 1, 0), ("error", 1, 1, 1)]
    arrive(own, folders[0], [(31, "view"), (50, "view")])
    drain()
    told = [("", 1, 1, 0), ("error", 1, 1, 1), ("view", 1, 3, 0)]
    assert days(spark, folders[1]) == told
    arrive(own, folders[0], [(2, "error"), (3, "view"), (100, "view")])
    drain()
    assert days(spark, folders[1]) == [*told, ("view", 2, 2, 0), ("view", 3, 2, 0)]
    last = {(r["stage"], r["day"].day): (r["closing"], r["due"]) for r in spark.read.parquet(folders[1]).collect()}
    plain = BASE.replace(tzinfo=None)
    assert last["view", 1] == (plain + datetime.timedelta(hours=23.5), plain + datetime.timedelta(hours=25.5))
    assert last["error", 1] == (plain + datetime.timedelta(hours=9), plain + datetime.timedelta(hours=24))


def test_sliding_windows_close_in_order_and_leave_late_rows_out(spark, tmp_path):
    folders = [str(tmp_path / k) for k in ("in", "out", "checkpoint")]

    def drain():
        stream = monitor.read_events(spark, folders[0])
        monitor.drain(keyed.sliding_counts(stream, length="3 days"), folders[1], folders[2])

    arrive(spark, folders[0], [(24 * d + 3, "error" if d == 1 else "view") for d in range(4)])
    drain()
    arrive(spark, folders[0], [(0, "view"), (24 * 9, "view")])
    drain()
    got = {(r["stage"], (r["start"].replace(tzinfo=datetime.timezone.utc) - BASE).days): (r["n"], r["failures"], r["total"]) for r in spark.read.parquet(folders[1]).collect()}
    want = {}
    for d in range(4):
        for start in range(d - 2, d + 1):
            n, failures, total = want.get(("error" if d == 1 else "view", start), (0, 0, 0.0))
            want["error" if d == 1 else "view", start] = (n + 1, failures + (d == 1), total + 2.0)
    assert got == want
