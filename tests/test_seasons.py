"""The provider's data source: partitions by file, seasons chosen before files are opened."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from touchline.sources import seasons
from touchline.sources.providers import CANONICAL


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, f"n{k}", str(1996 + k % 3)) for k in range(30)] + [(99, None, "2000/01")]
    path = f"{tmp_path}/players"
    spark.createDataFrame(rows, "player_id int, name string, season string").repartition(2).write.partitionBy("season").parquet(path)
    return path


def reader(path, **options):
    return seasons.SeasonReader(CANONICAL["players"], {"path": path, **options})


def test_seasons_choose_files(folder):
    every = reader(folder).partitions()
    assert {p.season for p in every} == {"1996", "1997", "1998", "2000/01"}
    one = reader(folder)
    assert list(one.pushFilters([EqualTo(("season",), "1997"), GreaterThan(("player_id",), 4)])) == [GreaterThan(("player_id",), 4)]
    assert {p.season for p in one.partitions()} == {"1997"}
    none = reader(folder)
    list(none.pushFilters([In(("season",), ("1996", "1997")), EqualTo(("season",), "1998")]))
    assert none.partitions() == []


def test_rows_come_in_canonical_columns(spark, folder):
    df = seasons.read_seasons(spark, folder, "players", "files")
    assert df.schema == CANONICAL["players"] and df.count() == 31
    got = df.filter("season = '1997' and player_id > 10").collect()
    assert sorted(q.player_id for q in got) == [k for k in range(11, 30) if k % 3 == 1]
    assert {(q.provider, q.season, q.team) for q in got} == {("files", "1997", None)}
    assert [q.player_id for q in df.filter("season = '2000/01'").collect()] == [99]


def test_unknown_seasons_are_empty_or_refused(spark, folder):
    assert seasons.read_seasons(spark, folder, "players", "files").filter("season = '1900'").collect() == []
    with pytest.raises(Exception, match="has no season 1900"):
        seasons.read_seasons(spark, folder, "players", "files", "error").filter("season = '1900'").collect()
