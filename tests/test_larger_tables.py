"""Queries on tables made larger by copies with shifted keys, which small tables do not show."""

import duckdb

from touchline.plans import monitoring, rating, statistics, validation  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def by_sql(folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(ORACLES[name]).fetchall())


def test_split_records_beside_keys_beyond_a_thousand(spark, tmp_path):
    """Keys run past 1000, where a second record's number is another player's, and copies share their names."""
    keys = [1, 2, 5, 1001, 1002, 1005, 2001]
    spark.createDataFrame([(k, f"Supplier {k % 1000}", 1, 0.0) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, 10 * k + g) for k in keys for g in range(4)], "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows_of(QUERIES["d19_merge_split"](spark, str(tmp_path)).select("name", "keep", "drop"))
    assert got == by_sql(tmp_path, "d19_merge_split", ["supplier"])
    assert [r[1:] for r in got if r[0] == "Supplier 1"] == [(1, 1001), (1001, 2001), (2001, 3001)]


def test_rounded_zeros_keep_their_sign(spark):
    """F2: SQL rounds -0.00001 to -0.0; Spark's rounding loses the sign."""
    import math

    from touchline.operators.rating import finished

    rows = spark.createDataFrame([(1, -0.00001, "FWD", 1.0, 10, 10), (2, 0.00001, "FWD", 1.0, 10, 10), (3, -0.5, "FWD", 1.0, 10, 10)], "player long, raw double, role string, confidence double, played int, available int")
    got = {r["player"]: r["raw_"] for r in finished(rows, "raw", ["role"]).collect()}
    assert got[1] == got[2] == 0 and math.copysign(1, got[1]) == -1 and math.copysign(1, got[2]) == 1
    assert got[3] == -0.5


def test_a_season_is_shuffled_once_for_all_vintages(spark):
    """F3 to F9, F18: what is summed by player and vintage needs no exchange but the one that brings a player's matches together; long seasons do not overflow."""
    from pyspark.sql import functions as F

    from touchline.operators.vintages import by_player

    values = [((7 * k) % 11) / 3 for k in range(2500)]
    rows = spark.createDataFrame([(1999, 1, 1 + k // 250, k, v) for k, v in enumerate(values)] + [(1999, 2, 5, 3, 2.5)], "season int, player long, rnd int, fixture long, v double")
    sums = by_player(rows, ["season"], [3, 6, 12], 0.3).groupBy("season", "as_of", "player").agg(F.sum(F.col("_weight") * F.col("v")).alias("form"), F.sum("_new").alias("played"), F.count("*").alias("n"))
    got = {(r["as_of"], r["player"]): r for r in sums.collect()}
    assert sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    for r in (3, 6, 12):
        known, form = values[: 250 * min(r, 10)], values[0]
        for v in known[1:]:
            form = 0.3 * v + 0.7 * form
        assert abs(got[r, 1]["form"] - form) < 1e-9 and got[r, 1]["n"] == len(known) and got[r, 1]["played"] == min(r, 10)
    assert (3, 2) not in got and got[6, 2]["form"] == 2.5


def test_facts_come_in_tasks_of_bounded_size(spark, monkeypatch):
    """the number of tasks grows with the lines, and what they come to stays the same."""
    from touchline.plans import binding

    small, want = spark.range(30), QUERIES["v_dataset_facts"](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(binding, "TASK_ROWS", 100)
    assert binding.parted(small, "id") is small
    assert binding.parted(spark.range(1000), "id").rdd.getNumPartitions() == 10
    assert QUERIES["v_dataset_facts"](spark, "/root/testdata/sf0.001").collect() == want


def test_slugs_of_one_file_are_made_by_many_tasks(spark, tmp_path):
    """F22."""
    spark.createDataFrame([(k, f"Large  ring {k}", "Brand#7") for k in range(50)], "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = QUERIES["f6_slug"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 4
    assert rows_of(made.select("part", "slug")) == by_sql(tmp_path, "f6_slug", ["part"])


def test_pointers_of_large_forests_are_thinned_before_they_are_doubled(spark, monkeypatch):
    """F16: what is doubled stays below a bound, all rounds before have few times the rows of the first, and forests, stars and rings come out the same."""
    from pyspark.sql import functions as F

    from touchline.operators import platform as P

    monkeypatch.setattr(P, "DOUBLED", 40, raising=False)
    written, plain = [], P.doubled
    monkeypatch.setattr(P, "doubled", lambda pointers: written.append(pointers.count()) or plain(pointers))
    n = 240
    chains, star, ring = {k: k - 3 for k in range(3, n)}, {k: n for k in range(n + 1, n + 60)}, {k: 300 + (k - 299) % 7 for k in range(300, 307)}
    parents = spark.createDataFrame([*(chains | star | ring).items(), (320, 303), (400, None)], "node long, parent long")
    start = spark.createDataFrame([(k,) for k in (100, n - 1, n, n + 7, 320, 400, 999)], "node long")
    above = {*range(1, 101, 3), *range(n - 1, 0, -3), n, n + 7, 320, *ring, 400, 999}
    below = {*range(100, n, 3), n - 1, n, *star, 320, 400, 999}
    assert sorted(r.node for r in P.ancestors(parents, start).collect()) == sorted(above)
    assert sorted(r.node for r in P.descendants(parents, start).collect()) == sorted(below)
    assert written and max(written) <= 41  # with the ring, which is one by then
    rounds = P.thinned(P.jumps(parents, start, ["node"]), from_above=False)
    assert len(rounds) > 3 and sum(r.filter(F.col("up").isNotNull()).count() for r in rounds) < 6 * (len(chains) + len(star) + len(ring))


def test_compared_tables_are_made_once(spark):
    """what the comparison gives is read off what was written, not off the lines again."""
    for name in ("d24_verdicts", "d24_regression_diff"):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "l_suppkey" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_edges_amid_equal_values_are_those_values(spark):
    """a quantile between two equal values is that value, not a hair below it, or all its copies go up a bin."""
    from touchline.operators.ordered import quantiles
    from touchline.operators.statistics import quantile_bins

    values = [1400 + (k * 7919 % 1003) * 0.3141593 for k in range(1003)]
    df = spark.createDataFrame([(v,) for v in values for _ in range(6)], "v double")
    con = duckdb.connect()
    con.execute("create table t as select v from (select unnest(?::double[]) as v), range(6)", [values])
    asked = [k / 20 for k in range(1, 20)]
    ordered, at = sorted(values * 6), [p * (6 * 1003 - 1) for p in asked]
    inside = [(k, ordered[int(i)]) for k, i in enumerate(at) if ordered[int(i)] == ordered[int(i) + 1]]
    got = quantiles(df, [], "v", asked).first().q
    assert len(inside) > 10 and [got[k] for k, _ in inside] == [v for _, v in inside]
    want = con.execute("select b, count(*) from (select 1 + len(list_filter(e, lambda q: q < v)) as b from t cross join (select quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) as e from t)) group by 1").fetchall()
    assert rows_of(quantile_bins(df, "v", 5).groupBy("bin").count()) == sorted(want)
    ends = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),)], "v double")
    assert quantiles(ends, [], "v", [0.5, 1.0]).first().q == [1.0, float("inf")]


def test_halves_are_rounded_as_in_sql(spark):
    """F2: a penalty of 0.9875 makes halves of the last digit; SQL rounds the product with 10,000, Spark's round the shortest decimal."""
    from touchline.operators.rating import finished

    rows = spark.range(-12_000, 12_001).selectExpr("id as player", "id / 10000D as raw", "'FWD' as role", "1D as confidence", "2 as played", "3 as available")
    got = {r["player"]: repr(r["raw_"]) for r in finished(rows, "raw", ["role"]).collect()}
    penalty = "(greatest(0.3, least(0.7, greatest(0, least(1, 2 / CAST(3 AS DOUBLE))))) - 0.3) / 0.4 * 0.15 + 0.85"
    drawn = "1 * (mu + (0.35 + 0.65 * 1::DOUBLE) * (raw - mu))"
    want = duckdb.sql(f"select k, round(round({drawn}, 4) * ({penalty}), 4) from (select *, avg(raw) over () as mu from (select k, k / 10000::double as raw from range(-12000, 12001) r(k)))").fetchall()
    assert got == {k: repr(v) for k, v in want}
    assert got[2840] == "0.2804" and got[2120] == "0.2094"
