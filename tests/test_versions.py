"""Repairs that take effect as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from touchline.sources.versions import VersionedTable

SCHEMA = "id int, part string, v int"


@pytest.fixture
def made(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id", "part"])
    table.create(spark.createDataFrame([(k, None if k % 5 == 0 else "a", k) for k in range(20)], SCHEMA))
    return table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_dry_run_tells_and_writes_nothing(spark, made, tmp_path):
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    next_ = made.read().filter("id <> 3").withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))).union(spark.createDataFrame([(50, "b", 1)], SCHEMA))
    told = made.repair(next_, {"small": F.col("v") < 60})
    assert (told.rows_in, told.rows_out, told.added, told.removed, told.changed, told.broken, told.version) == (20, 20, 1, 1, 1, {"small": 1}, None)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before and made.versions() == [1]


def test_a_broken_guard_leaves_the_old_version(spark, made, tmp_path):
    before = rows(made.read())
    told = made.repair(made.read().withColumn("v", F.when(F.col("id") != 4, F.col("v"))), {"has a value": F.col("v") >= 0}, dry_run=False)
    assert told.broken == {"has a value": 1} and told.version is None
    assert rows(made.read()) == before and made.versions() == [1]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 1


def test_versions_stay_readable_and_come_back(spark, made):
    before = rows(made.read())
    told = made.repair(made.read().filter("id < 10"), {"in range": F.col("id") < 10}, dry_run=False)
    assert (told.version, told.removed) == (2, 10) and made.read().count() == 10
    assert rows(made.read(1)) == before
    assert made.back_to(1) == 3 and rows(made.read()) == before and made.versions() == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        made.read(9)


def test_of_two_repairs_of_one_version_one_comes_through(spark, made):
    made._point(2, "rows-of-somebody")
    with pytest.raises(Exception, match="exist"):
        made._point(2, "rows-of-another")
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, made.folder + "-none", ["id"]).read()
