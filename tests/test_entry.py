"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def values(rows):
    return sorted(tuple(str(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x) for x in r) for r in rows)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = entry_points.oracle_sql().get(name)
    if sql:
        expected = con.sql(sql)
        assert sorted(expected.columns) == columns
        assert values(rows) == values(expected.select(*[f'"{c}"' for c in columns]).fetchall())
