"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from suite.registry import QUERIES
from tools.check import rows_of

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables are not there")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = registered.queries()[name](spark, TABLES)
    got = df.toPandas()
    assert name in registered.oracle_sql()
    text = registered.oracle_sql()[name]
    types = {r[0]: r[1] for r in sql.execute(f"DESCRIBE {text}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = sql.execute(text).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "eval"}
