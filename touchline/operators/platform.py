"""Season sets, calendars, lineage and anomaly measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def set_changes(rows: DataFrame, period: str, member: str) -> DataFrame:
    """(period, member, change): members that appear in a period, or that the period before had and it has not."""
    rows = rows.select(period, member).distinct()
    ends = rows.agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    shifted = rows.select((F.col(period) + 1).alias(period), member)
    new = rows.join(shifted, [period, member], "left_anti").join(ends).filter(F.col(period) > F.col("_first")).withColumn("change", F.lit("appeared"))
    gone = shifted.join(rows, [period, member], "left_anti").join(ends).filter(F.col(period) <= F.col("_last")).withColumn("change", F.lit("disappeared"))
    return new.union(gone).select(period, member, "change")


def complete_rounds(games: DataFrame, team: str, keys: list[str], played: str, by: list[str] | None = None) -> DataFrame:
    """(by..., complete_rounds): the longest run of n for which every team's n-th game is played."""
    by = by or []
    nth = games.withColumn("k", F.row_number().over(Window.partitionBy(*by, team).orderBy(*keys)))
    rounds = nth.groupBy(*by, "k").agg(F.bool_and(played).alias("complete"))
    return rounds.groupBy(*by).agg(F.coalesce(F.min(F.when(~F.col("complete"), F.col("k"))) - 1, F.max("k")).cast("long").alias("complete_rounds"))


def last_against_rest(rows: DataFrame, group: str, keys: list[str], value: str) -> DataFrame:
    """(group, z): the last value of each group in deviations (of the population) from all before it; null where they do not vary."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in keys]))
    ranked = rows.withColumn("k", k)
    last, rest = F.max(F.when(F.col("k") == 1, F.col(value))), F.when(F.col("k") > 1, F.col(value))
    return ranked.groupBy(group).agg(F.try_divide(last - F.avg(rest), F.nullif(F.stddev_pop(rest), F.lit(0.0))).alias("z"))


def severity(z, warn: float = 2.5, critical: float = 4.0):
    return F.when(F.abs(z) >= critical, "critical").when(F.abs(z) >= warn, "warn").otherwise("info")


def trust(z, warn: float = 2.5, critical: float = 4.0):
    """Confidence of a deviation: half at the warning level, whole at the critical one."""
    a = F.abs(z)
    return F.least(F.lit(1.0), F.when(a < warn, 0.5 * a / warn).otherwise(0.5 + 0.5 * (a - warn) / (critical - warn)))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): everything reachable from start (node) over edges (a, b), start included; cycles end by themselves.

    Breadth first: a level joins the edges with the nodes that the last one
    found, so each edge is followed once, and there is a round a level. Where
    every node has one parent, `ancestors` and `descendants` need fewer.
    """
    seen = cut(start.select("node").distinct())
    front = seen
    while True:
        front = cut(edges.join(front, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


#: pointers that are doubled as they are; of more, a quarter is taken out at a time until so many are left
DOUBLED = 1_000_000


def jumps(parents: DataFrame, start: DataFrame, on: list[str]) -> DataFrame:
    """(node, up, hit): the pointer of each node, and whether one of its columns `on` is in start (node); a node with more than one parent is refused."""
    kind = parents.select(F.coalesce("node", "parent").alias("k")).schema["k"].dataType
    up = F.col("parent").cast(kind)
    rows = parents.filter(F.col("parent").isNotNull()).groupBy(F.col("node").cast(kind).alias("node")).agg(F.min(up).alias("up"), (F.min(up) != F.max(up)).alias("_more"))
    for c in on:
        rows = rows.join(start.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    rows = cut(rows.select("node", "up", F.coalesce(*[F.col(f"_{c}") for c in on], F.lit(False)).alias("hit"), "_more"))
    if not rows.filter("_more").isEmpty():
        raise ValueError("a node has more than one parent")
    return rows.drop("_more")


def coin(c: str, k: int) -> Column:
    """A draw of a node for round k, which follows from the two alone."""
    return F.xxhash64(F.lit(k), F.col(c)).bitwiseAND(F.lit(1)) == 1


def out(k: int) -> Column:
    """Whether a pointer's node is taken out in round k: none of those leads to another, and about a quarter of all are."""
    return coin("node", k) & ~coin("up", k)


def thinned(rows: DataFrame, from_above: bool) -> list[DataFrame]:
    """Rows (node, up, hit), and what is left of them after each round, until at most DOUBLED are.

    Pointers that led to a node taken out lead to where that one did. Its hit
    goes to the pointers that led to it, or, if not from above, to the node that
    it led to; where that has no pointer of its own, a row with none says so.
    All rounds together have four times the rows of the first. What leads to
    itself, as a cycle does in the end, stays.
    """
    rounds = [rows]
    while rounds[-1].filter("node <> up").count() > DOUBLED:
        k, rows = len(rounds) - 1, rounds[-1].filter("up is not null")
        gone = rows.filter(out(k)).select(F.col("node").alias("_via"), F.col("up").alias("_far"), F.col("hit").alias("_hit"))
        stays = rows.filter(~out(k))
        led = stays.filter(coin("up", k)).join(gone, F.col("up") == F.col("_via"), "left")
        hit = F.col("hit") | F.coalesce("_hit", F.lit(False)) if from_above else F.col("hit")
        left = stays.filter(~coin("up", k)).union(led.select("node", F.coalesce("_far", "up").alias("up"), hit.alias("hit")))
        if not from_above:
            told = gone.filter("_hit").select(F.col("_far").alias("node"), F.lit(None).cast(rows.schema["up"].dataType).alias("up"), F.lit(True).alias("hit"))
            left = left.union(told.distinct()).groupBy("node").agg(F.max("up").alias("up"), F.bool_or("hit").alias("hit"))
        rounds.append(cut(left))
    return rounds


def doubled(pointers: DataFrame) -> DataFrame:
    """Pointers twice as far."""
    return cut(pointers.join(pointers.select(F.col("node").alias("up"), F.col("up").alias("_far")), "up").select("node", F.col("_far").alias("up")))


def reached(rows: DataFrame, follow) -> DataFrame:
    """(node): all that hits of (node, up, hit) lead to: follow(pointers, seen) gives the nodes one pointer on, and pointers are doubled each round."""
    seen, pointers = cut(rows.filter("hit").select("node").distinct()), cut(rows.filter("up is not null").select("node", "up"))
    n = seen.count()
    while True:
        seen = cut(seen.union(follow(pointers, seen)).distinct())
        before, n = n, seen.count()
        if n == before:
            return seen
        pointers = doubled(pointers)


def ancestors(parents: DataFrame, start: DataFrame) -> DataFrame:
    """(node): start (node) and all above it in a forest of (node, parent); cycles end by themselves.

    Nodes are taken out until few are left. There, pointers are doubled and what
    has been reached takes them once a round. Then rounds come back in turn: a
    node that was taken out is above start if it was hit, or if one that is led
    to it.
    """
    start = cut(start.select("node").distinct())
    rounds = thinned(jumps(parents, start, ["node"]), from_above=False)
    found = reached(rounds[-1], lambda pointers, seen: pointers.join(seen, "node").select(F.col("up").alias("node")))
    for k, rows in reversed(list(enumerate(rounds[:-1]))):
        rows = rows.filter("up is not null")
        led = rows.filter(~out(k) & coin("up", k)).join(found, "node", "left_semi").select(F.col("up").alias("node"))
        gone = rows.filter(out(k))
        found = cut(found.union(gone.filter("hit").select("node")).union(gone.filter("not hit").select("node").join(led, "node", "left_semi")))
    for rows in rounds[1:]:
        start = start.union(rows.filter("up is null").select("node"))
    return cut(start.union(found).distinct())


def descendants(parents: DataFrame, start: DataFrame) -> DataFrame:
    """(node): start (node) and all below it in a forest of (node, parent), in the same way.

    A node is below start if the one its pointer leads to is, or is hit: start
    or the like was on the way to there.
    """
    start = cut(start.select("node").distinct())
    rounds = thinned(jumps(parents, start, ["node", "up"]), from_above=True)
    found = reached(rounds[-1], lambda pointers, seen: pointers.join(seen.select(F.col("node").alias("up")), "up").select("node"))
    for k, rows in reversed(list(enumerate(rounds[:-1]))):
        gone = rows.filter(out(k))
        below = gone.filter("not hit").join(found.select(F.col("node").alias("up")), "up", "left_semi").select("node")
        found = cut(found.union(gone.filter("hit").select("node")).union(below))
    return cut(start.union(found).distinct())


def season_status(have: DataFrame, stated: DataFrame, ran: DataFrame, rounds: int, now: str) -> DataFrame:
    """season with available and missing rounds, coverage, checksum, hours since the last fixture and number of runs.

    have: (season, rnd, sum, last); stated: (season, rnd, stated); ran: (season, runs).
    """
    checked = have.join(stated, ["season", "rnd"], "left")
    found = checked.groupBy("season").agg(F.sort_array(F.collect_set("rnd")).alias("available"), F.bool_and(F.col("sum").eqNullSafe(F.col("stated"))).alias("_ok"), F.max("last").alias("_last"))
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", "_last").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    found = found.join(ran, "season", "left")
    missing = F.array_except(F.sequence(F.lit(1), F.lit(rounds)), "available").cast("array<bigint>")
    return found.select("season", "available", missing.alias("missing"), F.round(F.size("available") / F.lit(float(rounds)) * 100, 2).alias("coverage"), F.when(F.col("_ok"), "ok").otherwise("fail").alias("checksum"), hours.cast("long").alias("stale_hours"), F.coalesce("runs", F.lit(0)).alias("runs"))


def flow_chart(edges: DataFrame) -> DataFrame:
    """(kind, a, b, line): each edge with its line of a flow chart."""
    name = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    return edges.select("kind", "a", "b", F.concat(name("a"), F.lit(" -->|"), F.col("kind"), F.lit("| "), name("b")).alias("line"))


def due_notices(rounds: DataFrame, told: DataFrame, keys: list[str], now: str, wait_hours: int) -> DataFrame:
    """(keys..., due) of complete rounds that closed at least so long ago and that nobody was told of."""
    due = F.col("closing") + F.expr(f"interval {wait_hours} hours")
    ready = rounds.filter(F.col("complete") & (due <= F.lit(now).cast("timestamp_ntz"))).select(*keys, due.alias("due"))
    return ready.join(told, keys, "left_anti")
