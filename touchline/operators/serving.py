"""Queries that pages and reports ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .windows import place


def movers(before: DataFrame, after: DataFrame, key: str, value: str, n: int, least: int = 30, top: int = 100) -> DataFrame:
    """(key, moved, kind): the n largest gains and losses of place between two rankings, equal ones by key, and newcomers among the `top`.

    No row with fewer than `least` common entities; a newcomer has moved null.
    """
    a, b = place(before, value, [key], "_a").select(key, "_a"), place(after, value, [key], "_b").select(key, "_b")
    moved = cut(a.join(b, key).select(key, (F.col("_a") - F.col("_b")).alias("moved")))
    up = moved.orderBy(F.col("moved").desc(), key).limit(n).withColumn("kind", F.lit("up"))
    down = moved.orderBy("moved", key).limit(n).withColumn("kind", F.lit("down"))
    new = b.filter(F.col("_b") <= top).join(a, key, "left_anti").select(key, F.lit(None).cast("long").alias("moved"), F.lit("new").alias("kind"))
    enough = moved.agg((F.count("*") >= least).alias("_enough"))
    return up.union(down).union(new).join(enough).filter("_enough").drop("_enough")


def trios(pool: DataFrame, budget: float | None = None, least_roles: int = 2) -> DataFrame:
    """All trios a < b < c of (id, role, score, cost) with at least so many roles within the budget.

    Pairs that break the budget even with the cheapest third are cut before the third joins.
    """
    a, b, c = (pool.select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", "role", "score", "cost")]) for p in "abc")
    pairs = a.join(b, F.col("a_id") < F.col("b_id")).withColumn("_cost", F.col("a_cost") + F.col("b_cost"))
    if budget is not None:
        pairs = pairs.join(pool.agg(F.min("cost").alias("_least"))).filter(F.col("_cost") + F.col("_least") <= budget)
    trio = pairs.join(c, F.col("b_id") < F.col("c_id")).withColumn("cost", F.col("_cost") + F.col("c_cost")).withColumn("score", F.col("a_score") + F.col("b_score") + F.col("c_score"))
    roles = F.size(F.array_distinct(F.array("a_role", "b_role", "c_role")))
    if budget is not None:
        trio = trio.filter(F.col("cost") <= budget)
    return trio.filter(roles >= least_roles).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("c_id").alias("c"), "score", "cost")


def undominated(pool: DataFrame, order: list[Column], worth: Column, least_roles: int = 2, slices: int = 64) -> DataFrame:
    """The rows of a pool (id, role, score, cost) that the first trio by an order can have; none of them is lost.

    `order` is a total order in which a trio gets better if a member makes way
    for an earlier one of its role, and `worth` is what such a change must not
    lower (a constant where nothing else counts). A row that has as many earlier
    rows of its role with no less worth as a trio has places for the role is in
    no best trio. So many layers of undominated rows are kept, first in slices
    of the ids and then in what they leave. If worth falls strictly with the
    order, no row is dominated and the whole pool stays.
    """
    for by in (["role", F.pmod(F.hash("id"), F.lit(slices))], ["role"]):
        pool = pool.withColumn("_kept", F.lit(False))
        for _ in range(4 - least_roles):
            earlier = Window.partitionBy(*by, "_kept").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            pool = pool.withColumn("_kept", F.col("_kept") | F.coalesce(F.max(worth).over(earlier) < worth, F.lit(True)))
        pool = pool.filter("_kept").drop("_kept")
    return pool


def pick(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def best_dimensions(rows: DataFrame, key: str, ranks: list[str], n: int) -> DataFrame:
    """(key, dim, rank, place): the n dimensions in which each entity ranks best."""
    long = rows.unpivot([key], ranks, "dim", "rank")
    return long.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("rank", "dim")).cast("long")).filter(F.col("place") <= n)


def team_page(rows: DataFrame, qualified: Column, value: str, mins: str, most: int) -> DataFrame:
    """(team, player, part, place): a team's qualified players by value, and of the others the `most` with most minutes."""
    part = F.when(qualified, "ranked").otherwise("roster")
    by = F.when(qualified, F.col(value)).otherwise(F.col(mins).cast("double"))
    place_ = F.row_number().over(Window.partitionBy("team", "part").orderBy(F.col("_by").desc_nulls_last(), "player")).cast("long")
    placed = rows.withColumn("part", part).withColumn("_by", by).withColumn("place", place_)
    return placed.filter((F.col("part") == "ranked") | (F.col("place") <= most)).select("team", "player", "part", "place")
