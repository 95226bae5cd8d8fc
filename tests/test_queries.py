"""Every registered query with SQL gives the rows that the SQL gives."""

import datetime
import decimal
import math
import os

import pytest

import touchline.plans.inventory  # noqa: F401
import touchline.plans.monitoring  # noqa: F401
import touchline.plans.rating  # noqa: F401
import touchline.plans.scans  # noqa: F401
import touchline.plans.statistics  # noqa: F401
import touchline.plans.stores  # noqa: F401
import touchline.plans.validation  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def order(row):
    return tuple((v is None, type(v).__name__, repr(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=order)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows[:50]:
        for v in r:
            assert not (isinstance(v, float) and math.isnan(v))


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_text_operators(tmp_path):
    """The rest works where the text operators are not there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "touchline", tmp_path / "touchline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a1_sos' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
