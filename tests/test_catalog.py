"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import datetime
import glob
import math
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


def names():
    from tessera.queries import collect

    return sorted(collect()[0])


@pytest.mark.parametrize("name", names())
def test_query(spark, tables, name):
    from tessera.queries import collect

    queries, sql = collect()
    df = queries[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in sql:
        result = tables.execute(sql[name])
        head = [d[0] for d in result.description]
        assert sorted(head) == columns
        want = Counter(tuple(norm(r[head.index(c)]) for c in columns) for r in result.fetchall())
        assert got == want


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
