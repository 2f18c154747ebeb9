"""Every registered query against its SQL in DuckDB, on the smallest data."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from checks.registry import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
NO_SQL: set[str] = set()
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("events", "nation"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    yield connection
    connection.close()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = driver.queries()[name](spark, DATA)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert {c[0]: TYPES[str(c[1])] for c in cursor.description} == dict(result.dtypes)
    expected = sorted(tuple(map(shown, row)) for row in cursor.fetchall())
    found = sorted(tuple(map(shown, row)) for row in result.select(*columns).collect())
    assert found == expected


def test_entry(spark):
    report = driver.entry(spark)
    assert report.columns == ["seq", "title", "data"]
    assert report.count() == 7
