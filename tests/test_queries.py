"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tapeline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connection():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = connection().execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(x is not None, str(x)) for x in r]
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=key)
    assert got == sorted(([plain(x) for x in r] for r in cursor.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    where = SF.replace("sf0.001", "sf0.01") if name == "group_ic" else SF  # the smallest tables have too few symbols for a correlation in a group
    assert registry.QUERIES[name](spark, where).limit(1).count() == 1
