"""Every query with SQL against DuckDB on the smallest tables, where those are at hand."""

import math
import os

import pytest

import __spark_entry__ as entry

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = sorted(x.removesuffix(".parquet") for x in os.listdir(DIR)) if os.path.isdir(DIR) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{DIR}/{t}.parquet') else ''}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = df.collect()
    cur = duck.execute(entry.oracle_sql()[name])
    names, want = [x[0] for x in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in got]) == table(names, want)
