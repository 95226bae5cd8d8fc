"""The best trio by bounds, against all triples and against a pool whose best trio is known."""

import random
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from touchline.operators.selection import best_trio, cheapest_trio

POOL = "id long, role string, score decimal(9,4), cost decimal(9,2)"


def brute(rows, allowed, key, least_roles=2):
    made = []
    for t in combinations(sorted(rows), 3):
        if len({r[1] for r in t}) >= least_roles:
            made.append((tuple(r[0] for r in t), sum(r[2] for r in t), sum(r[3] for r in t)))
    return sorted(filter(allowed, made), key=key)[:1]


def shown(df):
    return [((r["a"], r["b"], r["c"]), r["score"], r["cost"]) for r in df.collect()]


def agrees(spark, rows, budget, target, least_roles=2):
    pool = spark.createDataFrame(rows, POOL)
    dear, cheap = (lambda t: (-t[1], t[0])), (lambda t: (t[2], t[0]))
    assert shown(best_trio(pool, budget, least_roles)) == brute(rows, lambda t: t[2] <= budget, dear, least_roles)
    assert shown(cheapest_trio(pool, target, least_roles)) == brute(rows, lambda t: t[1] >= target, cheap, least_roles)
    assert shown(cheapest_trio(pool, None, least_roles)) == brute(rows, lambda t: True, cheap, least_roles)


@pytest.mark.parametrize("seed", range(3))
def test_few_values_that_tie(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice("ABC"), Decimal(rng.randrange(6)), Decimal(rng.randrange(6))) for k in rng.sample(range(1000), 45)]
    agrees(spark, rows, 3, 13, least_roles=2 + seed % 2)


@pytest.mark.parametrize("shape", ["bent in", "bent out", "straight"])
def test_nobody_dominated(spark, shape):
    """A better score always costs more, so that no row can go before rows are put together."""
    rng = random.Random(shape)
    rows = []
    for k in range(120):
        x = k / 10 + rng.random() / 50
        cost = {"bent in": x * x, "bent out": 40 * x**0.5, "straight": 10 * x}[shape]
        rows.append((k * 7 % 120, rng.choice("ABCD"), Decimal(f"{x:.4f}"), Decimal(f"{cost:.2f}")))
    agrees(spark, rows, 150, 20)


def test_hundred_thousand_with_nobody_dominated(spark):
    """Scores 0, 1, 2, ... at their squares in cost: three of at least 3m + 1 cost least at m - 1, m, m + 2."""
    n, m = 100_000, 31_416
    k = F.col("id")
    pool = spark.range(n).select("id", F.when(k % 2 == 0, "A").otherwise("B").alias("role"), k.cast("double").alias("score"), (k * k).cast("double").alias("cost"))
    assert shown(cheapest_trio(pool, target=3 * m + 1)) == [((m - 1, m, m + 2), 3.0 * m + 1, 3.0 * m * m + 2 * m + 5)]
    best = shown(best_trio(pool, budget=3.0 * m * m + 2 * m + 5))
    assert best[0][1] == 3.0 * m + 1


def test_no_trio_and_rows_without_figures(spark):
    assert shown(best_trio(spark.createDataFrame([], POOL), 5)) == []
    rows = [(1, "A", Decimal(1), Decimal(1)), (2, "A", Decimal(1), Decimal(1)), (3, "A", Decimal(1), Decimal(1))]
    assert shown(cheapest_trio(spark.createDataFrame(rows, POOL))) == []
    rows += [(4, "B", Decimal(1), Decimal(9)), (5, "B", None, Decimal(0)), (6, "B", Decimal(5), None)]
    pool = spark.createDataFrame(rows, POOL)
    assert shown(best_trio(pool, 10)) == []
    assert shown(best_trio(pool, 11)) == [((1, 2, 4), Decimal(3), Decimal(11))]
    assert shown(cheapest_trio(pool, target=4)) == []


def test_plan_joins_on_steps(spark):
    """No pair is made by a join without an equal key."""
    from touchline.operators import selection

    ends = {"min_x": 0.0, "min_y": 0.0}
    rows = spark.range(50).select("id", F.lit("A").alias("role"), F.lit(1.0).alias("score"), F.lit(1.0).alias("cost"), F.rand(1).alias("_x"), F.rand(2).alias("_y"), F.rand(3).alias("_d"))
    plan = selection._ranked_trios(rows, 0.5, 1.0, 1.0, ends, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
