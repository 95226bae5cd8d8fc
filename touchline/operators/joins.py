"""Joins and reconciliations of the contest model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same keys, and added where there are none."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def as_of(rows: DataFrame, column: str, last: int) -> DataFrame:
    """Rows up to and with round `last`."""
    return rows.filter(F.col(column) <= last)


def thresholds(rows: DataFrame, share: float = 0.20, winter: float = 0.12, percentile: float = 0.3, least: int = 10) -> DataFrame:
    """base, winter and full_season minutes, from (team, rnd, player, mins) rows of one season."""
    games = rows.groupBy("team").agg(F.countDistinct("rnd").alias("n")).agg(F.max("n").alias("g"))
    players = rows.groupBy("player").agg(F.sum("mins").alias("mins"))
    mins = quantiles(players, [], "mins", [percentile]).select(F.col("q")[0].alias("p")).join(players.agg(F.count("*").alias("n")))
    base = F.floor(F.col("g") * 90 * share).cast("long")
    lifted = F.when(F.col("n") > least, F.floor("p").cast("long")).otherwise(F.lit(0))
    return games.join(mins).select(base.alias("base"), F.floor(F.col("g") * 90 * winter).cast("long").alias("winter"), F.greatest(base, lifted).alias("full_season"))


def exclude(registry: DataFrame, rows: DataFrame, out: Column, key: str = "player") -> tuple[DataFrame, DataFrame]:
    """Registry and facts without the entities for which `out` holds."""
    gone = registry.filter(out).select(key)
    return registry.join(gone, key, "left_anti"), rows.join(gone, key, "left_anti")


def match_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(declared, player): exact matches first, else matches without case, else null."""
    pairs = names.join(registry, F.lower("declared") == F.lower("name"), "left")
    return pairs.groupBy("declared").agg(F.coalesce(F.min(F.when(F.col("declared") == F.col("name"), F.col("player"))), F.min("player")).alias("player"))


def reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def opponents(log: DataFrame, fixture: str, team: str, columns: list[str]) -> DataFrame:
    """Each row of a team log beside the other sides of its fixture: opp_<team>, opp_<column>."""
    other = log.select(F.col(fixture).alias("_fixture"), F.col(team).alias(f"opp_{team}"), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return log.join(other, (F.col(fixture) == F.col("_fixture")) & (F.col(team) != F.col(f"opp_{team}"))).drop("_fixture")


def totals_without(registry: DataFrame, log: DataFrame, rows: DataFrame, period: str, amount: str) -> DataFrame:
    """(player, period, n_without, amount): what a player's team did in the fixtures in which the player has no row; none where there are no such.

    registry: (player, team); log: (team, fixture, period, amount), one row a team
    and fixture; rows: (player, fixture). What the team did in all its fixtures
    less what it did in the player's: no pair of player and missed fixture is made.
    """
    exact = lambda c: F.sum(c).cast("decimal(28,7)")  # noqa: E731  the widest decimals lose a digit where they are subtracted
    people = registry.select("player", "team")
    with_ = rows.select("player", "fixture").distinct().join(people, "player").join(log, ["team", "fixture"]).groupBy("player", period).agg(F.count("*").alias("_n"), exact(amount).alias("_x"))
    every = log.groupBy("team", period).agg(F.count("*").alias("_tn"), exact(amount).alias("_tx"))
    both = people.join(every, "team").join(with_, ["player", period], "left")
    left, rest = F.col("_tn") - F.coalesce("_n", F.lit(0)), F.col("_tx") - F.coalesce(F.col("_x"), F.lit(0).cast("decimal(28,7)"))
    return both.filter(left > 0).select("player", period, left.alias("n_without"), rest.alias(amount))


def personal_top(teams: DataFrame, rivals: DataFrame, n: int) -> DataFrame:
    """(team, rival, place): the n rivals with the least v, the team itself left out.

    The n + 1 best of all are enough for everybody, so a short ranked list meets
    the teams and each drops itself from it.
    """
    best = rivals.orderBy("v", "rival").limit(n + 1)
    order = Window.partitionBy("team").orderBy("v", "rival")
    return teams.join(best, F.col("team") != F.col("rival")).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n).select("team", "rival", "place")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails where a key repeats on either side."""
    order = Window.partitionBy(*keys)

    def single(df: DataFrame) -> DataFrame:
        counted = df.withColumn("_n", F.count(F.lit(1)).over(order))
        return counted.withColumn("_n", F.assert_true(F.col("_n") == 1, F.lit(f"{keys} repeat"))).filter(F.col("_n").isNull()).drop("_n")

    return single(left).join(single(right), keys)


def by_id_or_name(left: DataFrame, right: DataFrame, least: int, least_names: int = 20) -> DataFrame:
    """(player, other) by equal ids if at least `least` are common, else by names without case if `least_names` are; else no row."""
    ids = left.join(right.select(F.col("player").alias("other")), F.col("player") == F.col("other")).select("player", "other")
    names = left.select("player", F.lower("name").alias("_n")).join(right.select(F.col("player").alias("other"), F.lower("name").alias("_m")), F.col("_n") == F.col("_m")).select("player", "other")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    which = count(ids, "_i").join(count(names, "_j")).select(F.when(F.col("_i") >= least, "id").when(F.col("_j") >= least_names, "name").alias("_which"))
    both = ids.withColumn("_by", F.lit("id")).union(names.withColumn("_by", F.lit("name")))
    return both.join(which).filter(F.col("_by") == F.col("_which")).select("player", "other")


def compare(rows: DataFrame, key: str, one: int, two: int, dims: list[str], threshold: float) -> DataFrame:
    """(dim, one, two, differs) of two entities."""
    long = rows.unpivot([key], dims, "dim", "value")
    values = long.groupBy("dim").agg(F.max(F.when(F.col(key) == one, F.col("value"))).alias("a"), F.max(F.when(F.col(key) == two, F.col("value"))).alias("b"))
    return values.select("dim", F.round("a", 6).alias("one"), F.round("b", 6).alias("two"), (F.abs(F.col("a") - F.col("b")) >= threshold).alias("differs"))


def reconcile(left: DataFrame, right: DataFrame, owner: str, item: str) -> DataFrame:
    """Items of each owner on one side only and on both."""
    a = left.select(owner, item).distinct().withColumn("in_left", F.lit(True))
    b = right.select(owner, item).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, [owner, item], "full")
    return both.groupBy(owner).agg(
        F.count_if(F.col("in_right").isNull()).alias("only_left"), F.count_if(F.col("in_left").isNull()).alias("only_right"), F.count_if(F.col("in_left") & F.col("in_right")).alias("both")
    )


def top_overlap(rows: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """Number of keys among the n largest of both columns; equal values go by key."""
    one, two = (rows.orderBy(F.col(c).desc(), key).limit(n).select(key) for c in (a, b))
    return one.join(two, key).agg(F.count("*").alias("common"))


def full_outer_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def one_season(records: DataFrame, file: str, season: str, declared) -> DataFrame:
    """(file, seasons, usable): how many seasons a file's records are of, and whether all are of the declared one."""
    return records.groupBy(F.col(file).alias("file")).agg(F.countDistinct(season).alias("seasons"), F.coalesce(F.bool_and(F.col(season).eqNullSafe(F.lit(declared))), F.lit(False)).alias("usable"))
