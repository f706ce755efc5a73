"""Queries give their SQL's rows also on tables that are unlike the given ones."""

import os
import shutil

import duckdb
import pytest

from fastenlake.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    got = QUERIES[name](spark, str(folder))
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(text(r[names.index(c)]) for c in got.columns) for r in cursor.fetchall())
    assert sorted(tuple(map(text, r)) for r in got.collect()) == want and want


@pytest.fixture
def without_lines(tmp_path):
    """Every third customer's orders have lost their lines."""
    for t in ("customer", "part", "orders"):
        shutil.copy(f"{FOLDER}/{t}.parquet", tmp_path)
    duckdb.connect().execute(f"COPY (SELECT l.* FROM '{FOLDER}/lineitem.parquet' l JOIN '{FOLDER}/orders.parquet' ON l_orderkey = o_orderkey WHERE o_custkey % 3 <> 0) TO '{tmp_path}/lineitem.parquet'")
    return tmp_path


@pytest.mark.parametrize("name", ["override_reference", "match_with_history"])
def test_customers_whose_orders_have_no_lines_are_known(spark, without_lines, name):
    compare(spark, without_lines, name)
