"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# the run matrix shares one settled corpus
SLOW: set[str] = set()
NAMES = sorted(set(contract.oracle_sql()) - SLOW)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    found = contract.entry(spark)
    assert found.count() > 0 and found.columns == ["user", "events", "travel", "anomalies", "worst"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    found = contract.queries()[name](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(found.collect(), found.columns) == comparable(cursor.fetchall(), columns)
