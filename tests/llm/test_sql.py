"""Queries that SQL can express, against DuckDB; every query's rows against its input."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lapel.llm.queries import ORACLE, QUERIES
from tests.conftest import comparable
from tests.llm.data import DATA, table

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_answer(spark, duck, key):
    df = QUERIES[key](spark, DATA)
    names = sorted(df.columns)
    answer = duck.execute(ORACLE[key])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == {d[0]: str(d[1]) for d in answer.description}
    order = [d[0] for d in answer.description]
    expected = [tuple(row[order.index(n)] for n in names) for row in answer.fetchall()]
    assert comparable([tuple(r[n] for n in names) for r in df.collect()]) == comparable(expected)


def test_thirteen_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", ["op2_simhash_near_dedup", "op4_quality_rules", "op5_sentencepiece_dropout", "op6_secret_scan"])
def test_one_row_per_document(spark, key):
    found = sorted(r["doc_id"] for r in QUERIES[key](spark, DATA).select("doc_id").collect())
    assert found == sorted(r["doc_id"] for r in table(spark, "documents").select("doc_id").collect())
