"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

from checks import ORACLE, QUERIES
from checks.harness import compare, duck

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    con.execute(ORACLE[name])
    names = [d[0] for d in con.description]
    assert compare(df.columns, rows, names, con.fetchall()) is None
