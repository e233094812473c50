"""Every registered query against its SQL answer on the smallest data."""

from __future__ import annotations

import sys

import pytest
from conftest import ROOT, SF

sys.path.insert(0, str(ROOT / "tools"))
import duckdb  # noqa: E402
from check import TABLES, rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_answer_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
