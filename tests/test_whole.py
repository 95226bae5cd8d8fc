"""Queries over whole tables against brute force, with rows that the subsets of the compared queries leave out."""

import os
import re
import unicodedata
from itertools import combinations

import pytest

import touchline.plans.inventory  # noqa: F401
import touchline.plans.monitoring  # noqa: F401
import touchline.plans.scans  # noqa: F401
import touchline.plans.statistics  # noqa: F401
from touchline.operators import serving as V
from touchline.plans import statistics
from touchline.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def brute_trios(pool):
    for t in combinations(sorted(pool), 3):
        if len({r[1] for r in t}) >= 2:
            yield tuple(r[0] for r in t), sum(r[2] for r in t), sum(r[3] for r in t)


BEST = {
    "q1_best_trio": (lambda t: t[2] <= 12, lambda t: (-t[1], t[0]), lambda t: (*t[0], float(t[1]), float(t[2]))),
    "q2_cheapest_trio": (lambda t: True, lambda t: (t[2], t[0]), lambda t: (*t[0], float(t[2]))),
    "q3_target_trio": (lambda t: t[1] >= 29, lambda t: (t[2], t[0]), lambda t: (*t[0], float(t[2]))),
}


@needs_tables
@pytest.mark.parametrize("name", sorted(BEST))
def test_trio_of_the_whole_registry(spark, name):
    allowed, order, shown = BEST[name]
    pool = [tuple(r) for r in statistics.whole_pool(spark, SF).select("id", "role", "score", "cost").collect()]
    assert max(r[0] for r in pool) > 60
    want = shown(min(filter(allowed, brute_trios(pool)), key=order))
    assert [tuple(r) for r in QUERIES[name](spark, SF).collect()] == [want]


@pytest.mark.parametrize("seed", range(4))
def test_pruned_pool_keeps_the_first_trio(spark, seed):
    """Few values, so that many tie, with ids beyond 60 and costs of zero."""
    import random
    from decimal import Decimal

    from pyspark.sql import functions as F

    rng = random.Random(seed)
    rows = [(k, rng.choice("ABC"), Decimal(rng.randrange(6)), Decimal(rng.randrange(6))) for k in rng.sample(range(1000), 45)]
    pool = spark.createDataFrame(rows, "id long, role string, score decimal(9,4), cost decimal(9,2)")
    cases = [
        ([F.col("score").desc(), F.col("id")], -F.col("cost"), 3, lambda t: t[2] <= 3, lambda t: (-t[1], t[0]), [F.col("score").desc(), "a", "b", "c"]),
        ([F.col("cost"), F.col("id")], F.lit(0), None, lambda t: True, lambda t: (t[2], t[0]), ["cost", "a", "b", "c"]),
        ([F.col("cost"), F.col("id")], F.col("score"), None, lambda t: t[1] >= 13, lambda t: (t[2], t[0]), ["cost", "a", "b", "c"]),
    ]
    for k, (order, worth, budget, allowed, key, shown) in enumerate(cases):
        t = V.trios(V.undominated(pool, order, worth, slices=3), budget=budget)
        got = V.pick(t.filter("score >= 13") if k == 2 else t, shown).collect()
        want = sorted(filter(allowed, brute_trios(rows)), key=key)[:1]
        assert [((r["a"], r["b"], r["c"]), r["score"], r["cost"]) for r in got] == want


def test_trio_may_use_up_the_budget(spark):
    """Two that cost all of it leave room for a free third."""
    pool = spark.createDataFrame([(1, "A", 5.0, 6.0), (2, "B", 5.0, 6.0), (3, "B", 1.0, 0.0)], "id long, role string, score double, cost double")
    assert V.trios(pool, budget=12).count() == 1


@needs_tables
def test_every_event_is_cleaned(spark):
    events = {r[0]: None if r[0] % 3 == 0 else r[1] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect()}
    assert {r["run"]: r["value"] for r in QUERIES["f18_finite"](spark, SF).collect()} == events


@needs_tables
def test_every_event_is_rounded_by_its_exact_value(spark):
    events = {r[0]: round(r[1] / 8, 3) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect()}
    assert {r["run"]: r["v"] for r in QUERIES["m33_rounding"](spark, SF).collect()} == events


def test_rounding_of_ties_signs_and_nulls(spark):
    from touchline.operators.measures import round_exact

    values = [0.0625, -0.0625, 0.1875, -8.0575, 8.0575, 1.0005, -0.0004, 2.675, 123456.7895, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(round_exact(rows["v"], 3)).collect()] == [None if v is None else round(v, 3) for v in values]


@needs_tables
def test_every_error_has_its_reads(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type").collect()
    ids = {r[0] for r in rows}
    want = {r[0]: sum(10 * r[0] + k in ids and 10 * r[0] + k != r[0] for k in range(10)) for r in rows if r[1] == "error"}
    assert {r["run"]: r["children"] for r in QUERIES["d27_lineage_reads"](spark, SF).collect()} == want


@needs_tables
def test_health_counts_the_most_severe(spark):
    loss = {}
    for owner, value in spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'error'").select("user_id", "value").collect():
        loss[owner] = loss.get(owner, 0) + (20 if value > 150 else 5 if value > 140 else 0)
    got = {r["owner"]: r["score"] for r in QUERIES["m34_health"](spark, SF).collect()}
    assert got == {k: max(0, 100 - v) for k, v in loss.items()}
    assert len(set(got.values())) > 2


@needs_tables
def test_source_ids_of_every_order(spark):
    n = {}
    for (key,) in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect():
        n[key // 3] = n.get(key // 3, 0) + 1
    assert {r["source_id"]: r["n"] for r in QUERIES["d12_source_ids"](spark, SF).collect()} == {k: v for k, v in n.items() if v > 2}


def latin(s):
    from touchline.functions.text import ACCENTED, PLAIN

    if s is None:
        return None
    plain = re.sub("['.]", "", s.lower().translate(str.maketrans(ACCENTED, PLAIN)))
    return re.sub("[-\\s]+", " ", plain, flags=re.ASCII).strip(" ")


def unicode(s):
    if s is None:
        return None
    kept = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(kept.lower().split())


FOLDS = {"f2_unicode_fold": unicode, "f4_latin_fold": latin}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_beyond_the_beginning(spark, tmp_path, name):
    """Marks after 60 characters, a comma, a digit or a line break, in any language."""
    texts = ["Été, 3 Crème\nbrûlée", "x" * 70 + " Ünder-ﬁne", "1 Über d'Älteren", None, "", "Ñandú... " * 30]
    rows = [(k, t, lang) for k, t in enumerate(texts) for lang in ("de", "fr", None)]
    spark.createDataFrame([(10 * k + j, t, lang) for j, (k, t, lang) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["name"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {10 * k + j: FOLDS[name](t) for j, (k, t, lang) in enumerate(rows)}


@needs_tables
@pytest.mark.parametrize("name", sorted(FOLDS))
def test_folds_whole_documents(spark, name):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["name"]) for r in QUERIES[name](spark, SF).collect()), key=repr)
    assert got == sorted(((r["doc_id"], FOLDS[name](r["text"])) for r in rows), key=repr)


def test_bursts_and_stale_stages_are_reported(spark, tmp_path):
    """A view last seen five days before, and a day of many errors; values by brute force."""
    from datetime import datetime, timedelta
    from statistics import mean, pstdev

    now, rows = datetime(2024, 1, 30), []
    errors = [1, 2, 1, 2, 1, 2, 1, 2, 1, 20]
    for k, n in enumerate(errors):
        day = datetime(2024, 1, 20) + timedelta(days=k)
        rows += [(day + timedelta(hours=1 + j % 20), "error") for j in range(n)] + [(day + timedelta(hours=2), "signup")]
    rows.append((now - timedelta(hours=120), "view"))
    events = [(k, ts, 1, kind, 5.0, '{"k": 1}') for k, (ts, kind) in enumerate(rows)]
    for name, schema in (("lineitem", "l_suppkey long, l_orderkey long, l_linestatus string, l_quantity double, l_returnflag string, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz, l_linenumber int, l_partkey long"), ("orders", "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), ("customer", "c_custkey long, c_nationkey int"), ("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    z = (errors[-1] - mean(errors[:-1])) / pstdev(errors[:-1])
    got = sorted(tuple(r) for r in QUERIES["d25_anomalies"](spark, str(tmp_path)).collect())
    assert got == [("failures", "error", "critical", round(z, 5)), ("missing", "nothing", "critical", 0.0), ("missing", "signup", "warn", 10.0), ("stale", "view", "critical", 120.0)]


def test_coverage_comes_from_fixtures(spark):
    from touchline.plans.monitoring import coverage_of

    games = spark.createDataFrame([(1, 1999), (2, 1999), (3, 1999), (4, 2000)], "fixture long, season int")
    rows = spark.createDataFrame([(1,), (1,), (4,)], "fixture long")
    assert {r["season"]: round(r["pct"], 6) for r in coverage_of(games, rows).collect()} == {1999: 33.333333, 2000: 100.0}


@needs_tables
def test_every_event_has_its_place(spark):
    rank = {"error": 0, "purchase": 1}
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value").collect()
    want = sorted(rows, key=lambda r: (rank.get(r[1], 2), -r[2], r[0]))
    assert {r["run"]: r["place"] for r in QUERIES["t7_severity_sort"](spark, SF).collect()} == {r[0]: k for k, r in enumerate(want, 1)}


@needs_tables
def test_every_player_is_in_the_roster(spark):
    rows = QUERIES["s8_roster"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    want = sorted(rows, key=lambda r: (r["team"], r["role"], r["mins"] is None, -(r["mins"] or 0), r["player"]))
    assert [r["place"] for r in want] == list(range(1, len(rows) + 1))
