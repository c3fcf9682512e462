"""Every registered query against its SQL, on the small scale (ORACLE_SF_DIR for another)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT"} | {
    "boolean": "BOOLEAN"
}


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        # A result must not hold -0.0, which prints and hashes unlike 0.0.
        if isinstance(value, float):
            assert not (value == 0 and math.copysign(1, value) < 0)
        return value

    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )


def test_every_query_has_sql():
    from ratelake.plans.oracle import statements
    from ratelake.plans.queries import registered

    assert set(registered()) == set(statements())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    result = contract.queries()[name](spark, SF_DIR)
    expected = duck.execute(contract.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(names)
    kinds = {column[0]: str(column[1]) for column in expected.description}
    assert {column: TYPES[kind] for column, kind in result.dtypes} == kinds
    got = rows_by_name(result.columns, [tuple(row) for row in result.collect()])
    want = rows_by_name(names, expected.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got, "a query over the tables gives rows"


def test_entry(spark):
    assert contract.entry(spark).count() > 0
