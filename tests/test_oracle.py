"""Every registered query against independent SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lapel.plans.oracle import ORACLE
from lapel.plans.registry import REGISTRY
from tests.conftest import DATA, comparable

# Spark type -> DuckDB type; results must agree in type as well as in value.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_same_answer(spark, duck, key):
    df = REGISTRY[key](spark, DATA)
    names = sorted(df.columns)
    answer = duck.execute(ORACLE[key])
    types = {d[0]: str(d[1]) for d in answer.description}
    assert sorted(types) == names
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    order = [d[0] for d in answer.description]
    expected = [tuple(row[order.index(n)] for n in names) for row in answer.fetchall()]
    actual = [tuple(row[n] for n in names) for row in df.collect()]
    assert comparable(actual) == comparable(expected)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 10  # ten advisors at this size, each in a store of their own
    assert set(contract.oracle_sql()) <= set(contract.queries())
