import datetime
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import monitoring as M
from touchline.plans.lineage import LineageLog, retain
from touchline.sources import providers as P
from touchline.sources import snapshots as S
from touchline.streaming import monitor


def test_snapshot_is_sealed(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    folder = str(tmp_path / "snap")
    S.write_snapshot({"t": (df, ["k"])}, folder)
    assert S.verify_snapshot(spark, folder).count() == 0
    assert S.restore_snapshot(spark, folder, "t", str(tmp_path / "out")) == 50 and not (tmp_path / "out").exists()
    assert S.restore_snapshot(spark, folder, "t", str(tmp_path / "out"), dry_run=False) == 50
    with pytest.raises(FileExistsError):
        S.write_snapshot({"t": (df, ["k"])}, folder)
    S.write_snapshot({"t": (df.limit(5), ["k"])}, folder, force=True)
    victim = next((tmp_path / "snap" / "t").glob("*.parquet"))
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    victim.write_bytes(victim.read_bytes() + b"x")
    assert [r.error for r in S.verify_snapshot(spark, folder).collect()] == ["size"]
    victim.unlink()
    assert [r.error for r in S.verify_snapshot(spark, folder).collect()] == ["missing"]
    with pytest.raises(ValueError, match="damaged"):
        S.restore_snapshot(spark, folder, "t", str(tmp_path / "x"))


def test_canonical_frames(spark):
    df = spark.createDataFrame([("1", "1997-98", "Ana", "x", "A", "b", "n", "extra")], "player_id string, season string, name string, team string, position string, birth_date string, nationality string, more string")
    assert P.validate(df, "players") == ["missing column: provider"]
    with pytest.raises(P.SchemaViolation):
        P.enforce(df, "players")
    got = P.FixedProvider("p", {"players": df}).fetch(spark, "players", "1997-98")
    assert got.dtypes == spark.createDataFrame([], P.CANONICAL["players"]).dtypes and got.count() == 1
    assert P.FixedProvider("p", {}).fetch(spark, "teams", "1997-98").count() == 0
    with pytest.raises(ValueError):
        P.FixedProvider("p", {}).fetch(spark, "nothing", "1997-98")
    assert P.first_column(df, ["PTS", "Team"]) == "team" and P.first_column(df, ["q"]) is None
    with pytest.raises(P.SchemaViolation, match="no rows"):
        P.guard({"players": df}, {"players": ["season"]}, "2001-02")


def test_match_files(spark, tmp_path):
    side = {"1": {"player_id": "7", "player": "Ana", "position": "FW", "time": "90", "goals": "2", "xG": "1.5"}, "2": {"player_id": "8", "player": "Bo", "position": "Sub", "time": "0", "goals": "0", "xG": "0"}}
    (tmp_path / "match_101.json").write_text(json.dumps({"rosters": {"h": side, "a": {}}, "shots": {"h": [{"player": "Ana", "situation": "Penalty", "result": "Goal", "xG": "0.75"}], "a": []}}))
    (tmp_path / "match_102.json").write_text("{ broken")
    got = {r.player_id: r for r in P.match_rosters(spark, str(tmp_path)).collect()}
    assert (got[7].match, got[7].npg, got[7].npxg) == ("101", 1, 0.75) and got[8].mins == 0


def table(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double")


def test_regression_verdicts(spark):
    base = [((i * 37) % 101) / 50 for i in range(60)]
    verdict = lambda new: M.regression_diff(table(spark, base), table(spark, new), "k", "v").first()
    same = verdict(base)
    assert same.verdict == "SAFE" and same.rho == pytest.approx(1) and (same.top10, same.top20) == (10, 20)
    assert verdict([-x for x in base]).verdict == "CRITICAL"
    assert verdict([2 * x for x in base]).verdict == "CRITICAL"
    assert verdict(base[:40]).verdict == "CRITICAL"


def test_detectors_fire_and_stay_quiet(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(i, "a", at(24 * i), 10.0 + i % 2, False) for i in range(10)] + [(10, "a", at(24 * 10), 99.0, False)]
    rows += [(20 + i, "b", at(24 * i), 5.0, i == 9) for i in range(10)] + [(99, "c", at(0), 1.0, False)]
    df = spark.createDataFrame(rows, "run int, stage string, started timestamp, duration double, failed boolean").withColumn("started", F.col("started").cast("timestamp_ntz"))
    df = df.withColumn("warned", (F.col("stage") == "b") & (F.col("run") >= 26))
    held = spark.createDataFrame([("map", at(200 + i)) for i in range(25)] + [("old", at(-400)) for _ in range(200)], "source string, at timestamp").withColumn("at", F.col("at").cast("timestamp_ntz"))
    ratings = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, 2.0), (3, 1.2), (3, 2.4)], "vintage int, value double")
    found = {(r.detector, r.stage): r.severity for r in M.anomalies(df, "2024-01-11 06:00:00", expected={"a": 4, "d": 4}, quarantine=held, ratings=ratings).collect()}
    assert found["duration", "a"] == "critical" and ("duration", "b") not in found
    assert found["stale", "c"] == "critical" and ("stale", "a") not in found
    assert found["missing", "d"] == "critical" and ("missing", "a") not in found
    assert ("failures", "b") not in found  # days without failures do not vary
    assert found["warn_rate", "b"] == "warn" and ("warn_rate", "a") not in found
    assert found["escalation", "b"] == "critical" and ("escalation", "a") not in found
    assert found["quarantine", "map"] == "warn" and ("quarantine", "old") not in found
    assert found["drift", "ratings"] == "critical"
    calm = M.anomalies(df, "2024-01-11 06:00:00", quarantine=held.limit(3), ratings=ratings.filter("vintage < 3"))
    assert not {"quarantine", "drift", "missing"} & {r.detector for r in calm.collect()}


def test_checks_across_seasons(spark):
    players = spark.createDataFrame(
        [(1, 1, "Ana Silva", "X", "1990"), (1, 2, "Ana S Silva", "Y", "1990"), (2, 1, "Bo", "X", "1991"), (2, 2, "Cy", "X", "1992"), (3, 1, "Di", "Z", "1993"), (4, 1, "Di", "Z", "1993")],
        "player_id int, season int, name string, team string, birth_date string",
    )
    matches = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (9, 1)], "player_id int, season int")
    ratings = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.49), (2, 1, 0.0), (2, 2, 0.9)], "player_id int, season int, value double")
    coverage = spark.createDataFrame([(1, 79.0), (2, 49.0)], "season int, pct double")
    found = {(r.check, r.key): r.severity for r in M.across_seasons(players, matches, ratings, coverage).collect()}
    assert found["name", "1"] == "info" and found["name", "2"] == "warn" and found["birth_date", "2"] == "critical"
    assert found["identity", "Di"] == "critical" and found["transfer", "1"] == "info" and found["orphan", "9"] == "warn"
    assert found["idle", "4"] == "info" and found["jump", "2"] == "critical" and ("jump", "1") not in found
    assert found["coverage", "1"] == "warn" and found["coverage", "2"] == "critical" and found["club", "Y"] == "info"


def test_lineage_log(spark, tmp_path):
    log = LineageLog(spark, str(tmp_path))
    with log.scope("outer") as outer:
        with pytest.raises(KeyError), log.scope("inner", outer) as inner:
            log.artifact(inner, "out", "table", "/t")
            raise KeyError("x")
    reader = log.start("reader")
    log.artifact(reader, "in", "table", "/t")
    log.finish(outer, "fail")  # closed already
    status = {r.stage: r.status for r in log.runs().collect()}
    assert status == {"outer": "ok", "inner": "fail", "reader": "running"}
    assert {(r.a, r.b) for r in log.edges().collect()} == {(outer, inner), (inner, reader)}
    assert {r.stage for r in log.barren().collect()} == {"outer", "reader"}
    kept, dropped = retain(log.runs(), "at", "2000-01-01", 10)
    assert kept.count() == 3 and dropped.count() == 0


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(hours=i), i % 3, "error" if i % 4 == 0 else "view", float(i), "{}") for i in range(96)]
    spark.createDataFrame(rows, monitor.EVENT).repartition(4).write.parquet(str(tmp_path / "in"))
    monitor.drain(monitor.windowed_counts(monitor.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c1"))
    got = {(r.stage, r.start.day): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("error", 1)] == 6 and got[("view", 1)] == 18
    monitor.drain(monitor.notices(monitor.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 6
