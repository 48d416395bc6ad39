"""Each geometry query equals its SQL on the smallest tables."""

import math
import os

import pytest

from stavegrid.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else str(float(v)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(found.select(columns).collect()) == plain([[r[k] for k in order] for r in want.fetchall()])


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert registry.queries().keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
