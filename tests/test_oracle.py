"""Every registered query against its checking SQL on the smallest tables."""

import duckdb
import pytest
from check import RAW, compare

from flowledger.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in RAW:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, name, FOLDER)
    assert line.startswith(("ok", "ROWS")), line


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
