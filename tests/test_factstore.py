"""Upserts that replace whole seasons, and plans that read one season and shuffle nothing on the bucket key."""

import uuid

import pytest
from pyspark.sql import functions as F

from touchline.sources.factstore import FactStore

FACT = "fixture bigint, player bigint, goals int, season int"


@pytest.fixture
def store(spark):
    made = FactStore(spark, f"facts_{uuid.uuid4().hex}", "season", "player", ["fixture", "player"], 4)
    made.upsert(spark.createDataFrame([(f, p, (f + p) % 3, 1990 + f % 4) for f in range(40) for p in range(6)], FACT))
    yield made
    made.drop()


def rows(df):
    return sorted((q.season, q.fixture, q.player, q.goals) for q in df.collect())


def test_upsert_twice_is_upsert_once(spark, store):
    before = rows(store.table())
    changes = spark.createDataFrame([(1, 2, 9, 1991), (500, 2, 1, 1991), (2, 77, 4, 1995)], FACT)
    store.upsert(changes)
    once = rows(store.table())
    store.upsert(changes)
    assert rows(store.table()) == once
    want = {(s, f, p): g for s, f, p, g in before} | {(1991, 1, 2): 9, (1991, 500, 2): 1, (1995, 2, 77): 4}
    assert once == sorted((*k, g) for k, g in want.items())


def files(store, season):
    return {q.file for q in store.of(season).select(F.input_file_name().alias("file")).collect()}


def test_other_seasons_keep_their_files(spark, store):
    kept = files(store, 1990)
    touched = files(store, 1991)
    store.upsert(spark.createDataFrame([(1, 2, 9, 1991)], FACT))
    assert files(store, 1990) == kept and not files(store, 1991) & touched


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_season_is_one_partition_and_its_key_needs_no_shuffle(spark, store):
    one = store.of(1992)
    assert len(files(store, 1992)) <= 4 and all("season=1992" in f for f in files(store, 1992))
    text = plan(one.groupBy("player").agg(F.sum("goals")))
    assert "PartitionFilters: [isnotnull(season" in text or "PartitionFilters: [(season" in text or "season#" in text.split("PartitionFilters:")[1].split("]")[0]
    assert "Exchange" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = one.select("player", "goals").join(store.of(1993).select("player", F.col("fixture").alias("other")), "player")
        assert "Exchange" not in plan(both) and both.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_refuses_what_has_no_place(spark, store):
    with pytest.raises(ValueError, match="without"):
        store.upsert(spark.createDataFrame([(1, 2, 3, None)], FACT))
    with pytest.raises(ValueError, match="more than once"):
        store.upsert(spark.createDataFrame([(1, 2, 3, 1990), (1, 2, 4, 1990)], FACT))
    before = rows(store.table())
    store.upsert(spark.createDataFrame([], FACT))
    assert rows(store.table()) == before
