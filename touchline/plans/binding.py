"""Binds the contest model (players, fixtures, per-match facts) to the star schema of the test tables.

Suppliers are players with four roles, nations are teams, orders are fixtures
whose year is the season and whose month the round, and a line is what a player
did in a match. Amounts are decimals, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("GK", "DEF", "MID", "FWD")
AMOUNT = "decimal(18,7)"


#: rows that a task sorts or sums by keys; Spark's own number of tasks does not grow with a table
TASK_ROWS = 500_000


def parted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in as many tasks as hold TASK_ROWS each, by the keys if there are any, where Spark's own number of tasks is smaller."""
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ROLES)), (key % 4 + 1).cast("int"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, name, team, role, balance."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("player"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team"), role_of(F.col("s_suppkey")).alias("role"), F.col("s_acctbal").alias("balance"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixture, day, season, rnd, opp (the other side's team)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("fixture"), F.col("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("rnd"), F.col("c_nationkey").alias("opp")
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: player, team, role, fixture, season, rnd, opp, venue, mins, goal, xg, xa, bu (build-up) and the keys that order it."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("player"),
        F.col("l_orderkey").alias("fixture"),
        F.when(F.col("l_linestatus") == "O", "home").otherwise("away").alias("venue"),
        F.col("l_quantity").cast("int").alias("mins"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("goal"),
        (F.col("l_extendedprice") * F.col("l_discount") / 1000).cast(AMOUNT).alias("xg"),
        (F.col("l_extendedprice") * F.col("l_tax") / 1000).cast(AMOUNT).alias("xa"),
        (F.col("l_extendedprice") * (0.1 - F.col("l_discount")) / 1000).cast(AMOUNT).alias("bu"),
        F.col("l_shipdate").alias("ship"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
    )
    return parted(lines, "fixture").join(fixtures(spark, sf_dir).drop("day"), "fixture").join(players(spark, sf_dir).select("player", "team", "role"), "player")


def matches(rows: DataFrame) -> DataFrame:
    """One row for each player and fixture of the facts; the venue follows from fixture and team, so a team's rows agree on it."""
    venue = F.when((F.col("fixture") + F.col("team")) % 2 == 0, "home").otherwise("away").alias("venue")
    sums = [F.sum(c).alias(c) for c in ("mins", "goal", "xg", "xa", "bu")]
    return rows.filter("mins > 0").groupBy("player", "team", "role", "fixture", "season", "rnd", "opp", venue).agg(*sums)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline runs: run, stage, started, day, duration, failed, owner, size (from the JSON properties)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run"), F.col("event_type").alias("stage"), F.col("ts").alias("started"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("duration"),
        (F.col("event_type") == "error").alias("failed"), F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").cast("int").alias("size"),
    )


PLAYERS_SQL = """p AS (SELECT s_suppkey AS player, s_name AS name, s_nationkey AS team,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS role, s_acctbal AS balance FROM supplier)"""
FIXTURES_SQL = """x AS (SELECT o_orderkey AS fixture, o_orderdate AS day, CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS rnd, c_nationkey AS opp
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
FACTS_SQL = f"""{PLAYERS_SQL}, {FIXTURES_SQL},
f AS (SELECT player, fixture, season, rnd, p.team AS team, p.role AS role, opp, CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END AS venue,
  CAST(l_quantity AS INT) AS mins, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS goal,
  CAST(l_extendedprice * l_discount / 1000 AS DECIMAL(18,7)) AS xg, CAST(l_extendedprice * l_tax / 1000 AS DECIMAL(18,7)) AS xa, CAST(l_extendedprice * (0.1 - l_discount) / 1000 AS DECIMAL(18,7)) AS bu,
  l_shipdate AS ship, l_linenumber AS line, l_partkey AS part
  FROM lineitem JOIN x ON l_orderkey = x.fixture JOIN p ON l_suppkey = p.player)"""
MATCHES_SQL = """m AS (SELECT player, team, role, fixture, season, rnd, opp, CASE WHEN (fixture + team) % 2 = 0 THEN 'home' ELSE 'away' END AS venue,
  CAST(sum(mins) AS BIGINT) AS mins, CAST(sum(goal) AS BIGINT) AS goal, sum(xg) AS xg, sum(xa) AS xa, sum(bu) AS bu FROM f WHERE mins > 0 GROUP BY ALL)"""
RUNS_SQL = """r AS (SELECT event_id AS run, event_type AS stage, ts AS started, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS duration,
  event_type = 'error' AS failed, user_id AS owner, CAST(json_extract_string(props, '$.k') AS INT) AS size FROM events)"""
