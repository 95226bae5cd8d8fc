"""The best three of a pool by bounds: neither all pairs nor all triples are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .serving import pick, trios, undominated

STEPS = 24


def best_trio(pool: DataFrame, budget: float | None = None, least_roles: int = 2) -> DataFrame:
    """(a, b, c, score, cost): the three of highest score within the budget, equal ones by ids; no row if there are none.

    The pool has (id, role, score, cost) with unique ids; rows without score or
    cost take no part, rows without a role have one role in common.
    """
    return _first(pool, "score", budget, least_roles)


def cheapest_trio(pool: DataFrame, target: float | None = None, least_roles: int = 2) -> DataFrame:
    """(a, b, c, score, cost): the three of least cost whose scores sum to the target at least, else as best_trio."""
    return _first(pool, "cost", target, least_roles)


def _first(pool: DataFrame, by: str, limit, least_roles: int) -> DataFrame:
    """The first trio by goal and ids of those whose spending is in the limit.

    For any price p >= 0, the goal of an allowed trio is at least L = 3 min(goal
    + p spent) - p limit, and exceeds L by at least the sum of what its members
    lie above that minimum. So with a trio of goal T at hand, only members that
    lie up to T - L above it count, and their sum is bounded likewise. The price
    of the largest L is searched by a few aggregations, and the trio at hand comes
    from the first rows of each role. Then sums are let grow, eight times each
    step, until the best found proves that nothing beyond can be better. What a
    step joins are the rows within its bound, in rank order and by steps of it;
    if goal and spending trade off at one constant price, that is all rows.
    """
    spark = pool.sparkSession
    best_first = by == "score"
    goal, spent = (-F.col("score"), F.col("cost")) if best_first else (F.col("cost"), -F.col("score"))
    order = [F.col("score").desc() if best_first else F.col("cost"), "a", "b", "c"]
    if limit is None:
        spent, edge, allowed = F.lit(0), 0.0, F.lit(True)
    else:
        edge = float(limit if best_first else -limit)
        allowed = (F.col("cost") <= F.lit(limit)) if best_first else (F.col("score") >= F.lit(limit))
    base = pool.select("id", "role", "score", "cost", goal.cast("double").alias("_x"), spent.cast("double").alias("_y"))
    base = cut(base.filter("id is not null and score is not null and cost is not null and not isnan(_x) and not isnan(_y)"))
    schema = trios(base, None, least_roles).schema
    ends = base.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("_x", "_y") for f in (F.min, F.max)]).first()
    if ends["min_x"] is None:
        return spark.createDataFrame([], schema)

    price, bound = _price(base, ends, edge) if limit is not None else (0.0, 3 * ends["min_x"])
    slack = 1e-9 * (1 + abs(bound) + price * abs(edge) + max(abs(ends["min_x"]), abs(ends["max_x"])) + price * max(abs(ends["min_y"]), abs(ends["max_y"])))
    level = (bound + price * edge) / 3
    ranked = base.withColumn("_d", F.col("_x") + price * F.col("_y") - level)

    best = pick(trios(_leaders(ranked), None, least_roles).filter(allowed), order).first()
    if best is None:
        return spark.createDataFrame([], schema)
    at = lambda row: float(-row["score"] if best_first else row["cost"])
    gap = at(best) - bound + slack
    widths = [gap / 8**k for k in range(6)]
    near = ranked.agg(*[F.count_if(F.col("_d") <= w).alias(f"n{k}") for k, w in enumerate(widths)]).first()
    start = max([k for k in range(6) if near[f"n{k}"] >= 256], default=0)
    for width in widths[start::-1]:
        width = min(width, at(best) - bound + slack)
        rows = undominated(ranked.filter(F.col("_d") <= width), [F.col("_x"), F.col("id")], -F.col("_y"), least_roles)
        made = _ranked_trios(rows, width, edge + slack if limit is not None else None, at(best) + slack, ends, least_roles)
        found = pick(made.filter(allowed).unionByName(spark.createDataFrame([best], schema)), order).first()
        best = found
        if at(best) - bound + slack <= width:
            break
    return spark.createDataFrame([best], schema)


def _price(base: DataFrame, ends, edge: float) -> tuple[float, float]:
    """The price with the largest bound: powers of two of the ratio of the spans, then ever closer between the neighbours of the best.

    The bound is concave in the price, so a round narrows its place 16 times; it ends when a round gains
    next to nothing. What is left is only a wider gap, never a wrong bound.
    """
    wide_x, wide_y = ends["max_x"] - ends["min_x"], ends["max_y"] - ends["min_y"]
    ratio = (wide_x / wide_y) if wide_x > 0 and wide_y > 0 else 1.0

    def bounds(prices):
        row = base.agg(*[F.min(F.col("_x") + p * F.col("_y")).alias(f"p{k}") for k, p in enumerate(prices)]).first()
        return max((3 * row[k] - p * edge, p) for k, p in enumerate(prices))

    bound, price = bounds([0.0, *[ratio * 2.0**k for k in range(-16, 17)]])
    reach = price if price > 0 else ratio * 2.0**-16
    for _ in range(8):
        step = reach / 16
        closer, at = max((bound, price), bounds([max(0.0, price + step * k) for k in range(-16, 17) if k]))
        gained, bound, price, reach = closer - bound, closer, at, step
        if gained <= 1e-6 * (1 + abs(bound)):
            break
    return price, bound


def _leaders(ranked: DataFrame, most: int = 24, few: int = 3) -> DataFrame:
    """The first rows of each role by what they lie above the minimum, by spending and by goal: some trio of them is allowed if any is."""
    parts = []
    for value, n in (("_d", most), ("_y", few), ("_x", few)):
        place = F.row_number().over(Window.partitionBy("role").orderBy(value, "id"))
        parts.append(ranked.withColumn("_k", place).filter(F.col("_k") <= n).drop("_k"))
    return parts[0].union(parts[1]).union(parts[2]).dropDuplicates(["id"])


def _ranked_trios(rows: DataFrame, width: float, edge: float | None, most: float, ends, least_roles: int) -> DataFrame:
    """Trios of rows in rank order whose distances sum to the width at most, joined on steps of the distance.

    A pair is kept only if with the least spending and the least goal of all it could still be within the limit and the best.
    """
    step = width / STEPS

    def side(p):
        return rows.select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", "role", "score", "cost", "_x", "_y", "_d")], F.floor(F.col("_d") / step).cast("int").alias(f"{p}_step"))

    def after(p, q):
        return (F.col(f"{q}__d") > F.col(f"{p}__d")) | ((F.col(f"{q}__d") == F.col(f"{p}__d")) & (F.col(f"{q}_id") > F.col(f"{p}_id")))

    def reach(left):
        return F.floor(left / step).cast("int") + 1

    a, b, c = side("a"), side("b"), side("c")
    left = width - F.col("a__d")
    pairs = a.filter(F.col("a__d") * 3 <= width).withColumn("b_step", F.explode(F.sequence("a_step", F.greatest("a_step", reach(left / 2)))))
    pairs = pairs.join(b, "b_step").filter(after("a", "b") & (F.col("a__d") + 2 * F.col("b__d") <= width))
    pairs = pairs.filter(F.col("a__x") + F.col("b__x") + ends["min_x"] <= most)
    if edge is not None:
        pairs = pairs.filter(F.col("a__y") + F.col("b__y") + ends["min_y"] <= edge)
    left = width - F.col("a__d") - F.col("b__d")
    made = pairs.withColumn("c_step", F.explode(F.sequence("b_step", F.greatest("b_step", reach(left)))))
    made = made.join(c, "c_step").filter(after("b", "c") & (F.col("a__d") + F.col("b__d") + F.col("c__d") <= width))
    made = made.filter(F.size(F.array_distinct(F.array("a_role", "b_role", "c_role"))) >= least_roles)
    ids = F.array_sort(F.array("a_id", "b_id", "c_id"))
    return made.select(*[ids[k].alias(p) for k, p in enumerate("abc")], *[(F.col(f"a_{v}") + F.col(f"b_{v}") + F.col(f"c_{v}")).alias(v) for v in ("score", "cost")])
