"""Registered corpus queries: against their SQL, and the others whole and with their columns."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from logwarden.llm.oracles import ORACLES
from logwarden.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": ["doc_id", "fingerprint", "component_id"],
    "op2_": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_": ["doc_id", "n_entities", "spans", "text"],
}


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_whole_table_and_columns(spark, prefix):
    (name,) = [n for n in QUERIES if n.startswith(prefix)]
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[prefix]
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
