"""Every table query gives the rows of its SQL."""

import math

import duckdb
import pytest

from lodestrata.plans.table_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    held = sql.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLES[name]})")
    assert plain(found.select(*columns).collect()) == plain(held.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
