"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from scriptorium.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "events documents pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    res = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()), key=repr)
    assert mine == theirs
