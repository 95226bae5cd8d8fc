"""Canonical frames of data providers, and scans of semi-structured match files."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _of(**kinds) -> StructType:
    names = {"text": StringType(), "whole": LongType(), "real": DoubleType()}
    return StructType([StructField(name, names[kind]) for name, kind in kinds.items()])


# fixed values: columns of the canonical frames, in contract order
CANONICAL = {
    "players": _of(player_id="whole", provider="text", season="text", name="text", team="text", position="text", birth_date="text", nationality="text"),
    "player_matches": _of(player_id="whole", provider="text", season="text", giornata="whole", team="text", opponent="text", minutes="whole", goals="whole", assists="whole", xg="real", xa="real", shots="whole", yellow_cards="whole", red_cards="whole"),
    "teams": _of(team_id="whole", provider="text", season="text", name="text", league="text"),
}


class SchemaViolation(ValueError):
    pass


def validate(df: DataFrame, kind: str) -> list[str]:
    """Complaints about missing columns; more columns are allowed."""
    return [f"missing column: {f.name}" for f in CANONICAL[kind] if f.name not in df.columns]


def enforce(df: DataFrame, kind: str) -> DataFrame:
    """The canonical columns in order and type, nothing else."""
    if complaints := validate(df, kind):
        raise SchemaViolation("; ".join(complaints))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CANONICAL[kind]])


class Provider(Protocol):
    name: str

    def fetch(self, spark: SparkSession, kind: str, season: str) -> DataFrame: ...


class FixedProvider:
    """A provider whose frames are given; unknown kinds and seasons have no rows."""

    def __init__(self, name: str, frames: dict[str, DataFrame]):
        self.name, self.frames = name, frames

    def fetch(self, spark: SparkSession, kind: str, season: str) -> DataFrame:
        if kind not in CANONICAL:
            raise ValueError(f"unknown kind: {kind}")
        if kind not in self.frames:
            return spark.createDataFrame([], CANONICAL[kind])
        df = self.frames[kind].withColumn("provider", F.lit(self.name))
        return enforce(df, kind).filter(F.col("season") == season)


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that the table has, in whatever case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def guard(tables: dict[str, DataFrame], needs: dict[str, list[str]], season: str | None = None) -> None:
    """Fails where a table or column is missing, or the season has no rows."""
    for name, columns in needs.items():
        if name not in tables:
            raise SchemaViolation(f"missing table: {name}")
        if missing := [c for c in columns if c not in tables[name].columns]:
            raise SchemaViolation(f"{name} has no {', '.join(missing)}")
        if season is not None and "season" in columns and tables[name].filter(F.col("season") == season).isEmpty():
            raise SchemaViolation(f"{name} has no rows of {season}")


MATCH = "rosters map<string, map<string, struct<player_id:string, player:string, position:string, time:string, goals:string, xG:string>>>, shots map<string, array<struct<player:string, situation:string, result:string, xG:string>>>"


def match_rosters(spark: SparkSession, folder: str) -> DataFrame:
    """roster_rows of the match files below a folder, which are named by their match; files that are no JSON are left out."""
    files = spark.read.schema(MATCH + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return roster_rows(files.withColumn("match", F.regexp_extract(F.input_file_name(), "([0-9]+)[^/]*$", 1)).filter("_corrupt is null"))


def parsed_matches(texts: DataFrame) -> DataFrame:
    """(match, rosters, shots) of (match, text) rows; texts that are no JSON are left out."""
    return texts.select("match", F.from_json("text", MATCH).alias("m")).filter("m.rosters is not null").select("match", "m.rosters", "m.shots")


def roster_rows(files: DataFrame) -> DataFrame:
    """(match, side, player_id, player, position, mins, goals, xg, npg, npxg) of parsed matches.

    Penalties are taken off by player and match, not below zero.
    """
    shots = files.select("match", F.explode(F.flatten(F.map_values("shots"))).alias("s")).filter("s.situation = 'Penalty'")
    penalties = shots.groupBy("match", F.col("s.player").alias("player")).agg(F.sum(F.col("s.xG").cast("double")).alias("pen_xg"), F.count_if(F.col("s.result") == "Goal").alias("pen_goals"))
    rows = files.select("match", F.explode("rosters").alias("side", "r")).select("match", "side", F.explode(F.map_values("r")).alias("r"))
    rows = rows.select("match", "side", F.col("r.player_id").cast("long").alias("player_id"), F.col("r.player").alias("player"), F.col("r.position").alias("position"), F.col("r.time").cast("int").alias("mins"), F.col("r.goals").cast("int").alias("goals"), F.col("r.xG").cast("double").alias("xg"))
    joined = rows.join(penalties, ["match", "player"], "left")
    return joined.withColumn("npg", F.greatest(F.lit(0), F.col("goals") - F.coalesce("pen_goals", F.lit(0)))).withColumn("npxg", F.greatest(F.lit(0.0), F.col("xg") - F.coalesce("pen_xg", F.lit(0.0)))).drop("pen_xg", "pen_goals")


def position_minutes(rows: DataFrame, matches: DataFrame, normal) -> DataFrame:
    """(name, position, mins, thin): minutes by normalised name and position over the league's matches, without substitutes and zero minutes.

    rows: (match, name, position, mins); matches: (match). Fails without matches;
    `thin` tells that rows of less than half of them were found.
    """
    if matches.isEmpty():
        raise SchemaViolation("no matches of the league")
    ours = rows.join(matches.select("match").distinct(), "match", "left_semi")
    read = ours.agg(F.countDistinct("match").alias("_read")).join(matches.agg(F.countDistinct("match").alias("_all"))).select((2 * F.col("_read") < F.col("_all")).alias("thin"))
    played = ours.filter("position <> 'Sub' and mins > 0")
    return played.groupBy(normal(F.col("name")).alias("name"), "position").agg(F.sum("mins").alias("mins")).join(read)


def enrich(people: DataFrame, given: DataFrame, season) -> DataFrame:
    """people with the columns of (player, season, ...) rows of exactly that season; without such a row they stay null."""
    return people.join(given.filter(F.col("season").eqNullSafe(F.lit(season))).drop("season"), "player", "left")
