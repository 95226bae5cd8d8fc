"""Places, running totals, recursions and quantiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ordered as O
from touchline.operators import statistics as S
from touchline.operators.windows import place, rank_average, rank_min


def folded(values, alpha):
    made = []
    for x in values:
        made.append(x if not made else alpha * x + (1 - alpha) * made[-1])
    return made


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.97, 1.0])
def test_recursive_mean_of_any_weight(spark, alpha):
    r = random.Random(3)
    groups = {"a": 400, "b": 3000, "c": 1, None: 7}
    rows = [(g, k, r.uniform(-5, 30)) for g, n in groups.items() for k in range(n)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame([*shuffled, ("a", -1, None)], "g string, k int, x double")
    got = {(q.g, q.k): (q.s, q.pos) for q in O.recursive_mean(df, ["g"], [F.col("k")], "x", "s", alpha).collect()}
    assert len(got) == len(rows)
    for g in groups:
        want = folded([x for h, _, x in rows if h == g], alpha)
        for k, s in enumerate(want):
            assert got[g, k][0] == pytest.approx(s, rel=1e-11, abs=1e-11) and got[g, k][1] == k


def test_recursive_mean_refuses_other_weights_and_takes_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, k int, x double")
    assert O.recursive_mean(empty, ["g"], [F.col("k")], "x", "s").collect() == []
    with pytest.raises(ValueError):
        O.recursive_mean(empty, ["g"], [F.col("k")], "x", "s", 0.0)


def test_runs_shorter_than_a_block_compose(spark, monkeypatch):
    monkeypatch.setattr(O, "DECADES", 2)
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    got = [q.s for q in O.recursive_mean(df, ["g"], [F.col("k")], "x", "s", 0.5).orderBy("k").collect()]
    assert got == pytest.approx(folded([float(k * 37 % 101) for k in range(500)], 0.5), rel=1e-12)


def test_quantiles_equal_numpy(spark):
    r = random.Random(5)
    groups = {1: [r.gauss(0, 1) for _ in range(5000)], 2: [7.0] * 900 + [r.random() for _ in range(30)], 3: [4.5], None: [1.0, 2.0], 5: [10.0**k for k in range(-150, 150)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(1, None), (1, float("nan")), (6, None)], "g int, v double")
    probs = [0.0, 0.05, 0.3, 0.5, 0.95, 1.0]
    got = {q.g: q.q for q in O.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12, abs=1e-12)


def test_a_coarse_sketch_still_gives_exact_quantiles(spark):
    r = random.Random(6)
    values = [float(r.randrange(400)) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = O.quantiles(df, [], "v", [0.01, 0.25, 0.5, 0.999], accuracy=50).first().q
    assert got == pytest.approx(list(np.quantile(values, [0.01, 0.25, 0.5, 0.999])))


def test_quantiles_of_ten_million_distinct_values(spark):
    n = 10_000_019  # a prime: every remainder occurs once
    df = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    assert O.quantiles(df, [], "v", [0.05, 0.5, 0.95]).first().q == pytest.approx([0.05 * (n - 1), 0.5 * (n - 1), 0.95 * (n - 1)], rel=1e-14)


def test_ranks_and_places_with_one_frequent_value(spark):
    r = random.Random(7)
    rows = [(k, k % 3, None if k % 50 == 0 else (5 if k % 2 else r.randrange(9))) for k in range(1200)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    order = lambda q: (q[2] is None, -(q[2] or 0), q[0])
    whole = sorted(rows, key=order)
    assert {q.id: q.p for q in place(df, "v", ["id"], "p").collect()} == {q[0]: k for k, q in enumerate(whole, 1)}
    inside = {g: [q for q in whole if q[1] == g] for g in range(3)}
    assert {q.id: q.p for q in place(df, "v", ["id"], "p", ["g"]).collect()} == {q[0]: k for qs in inside.values() for k, q in enumerate(qs, 1)}

    def by_hand(qs):
        values = [q[2] for q in qs]
        return {q[0]: (values.index(q[2]) + 1, values.count(q[2])) for q in qs}

    want = {i: x for qs in inside.values() for i, x in by_hand(qs).items()}
    assert {q.id: q.r for q in rank_min(df, "v", "r", ["g"]).collect()} == {i: first for i, (first, _) in want.items()}
    assert {q.id: q.r for q in rank_average(df, "v", ["g"], "r", floor=False).collect()} == {i: first + (n - 1) / 2 for i, (first, n) in want.items()}


def test_group_figures_join_by_shuffle_where_groups_are_many(spark, monkeypatch):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k % 4, float(k)) for k in range(40)], "id int, g int, v double")
    few = {q.id: q.m for q in O.with_means(df, ["g"], {"m": "v"}).collect()}
    monkeypatch.setattr(O, "GROUPS", 1)
    assert {q.id: q.m for q in O.with_means(df, ["g"], {"m": "v"}).collect()} == few
    assert few[0] == np.mean(range(0, 40, 4)) and few[3] == np.mean(range(3, 40, 4))


def test_kendall_with_frequent_values(spark):
    r = random.Random(9)
    rows = [(k, float(r.randrange(6)), float(r.choice([1, 1, 1, 2, 3, 8]))) for k in range(150)]
    got = S.kendall(spark.createDataFrame(rows, "id int, x double, y double"), "x", "y", "id").first()
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(sign(a[1] - b[1]), sign(a[2] - b[2])) for i, a in enumerate(rows) for b in rows[:i]]
    want = sum(x * y for x, y in pairs) / (sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs)) ** 0.5
    assert got.n == 150 and got.tau == pytest.approx(want)
