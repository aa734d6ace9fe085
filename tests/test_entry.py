import duckdb
import pytest

import __spark_entry__ as entry
from registry.queries import TABLES
from tools.check_oracles import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.QUERIES) - set(entry.oracle_sql()) == {"q_match", "q_detect"}


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_its_sql_twin(spark, connection, name):
    verdict = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert verdict.startswith(("ok", "rows only")), verdict
