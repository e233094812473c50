from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from verdure.session import build_session, clear_scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="verdure-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Small literal table: rows and a schema text."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def values(df, *columns, order=None):
    """Rows as tuples, sorted by the given columns."""
    rows = df.orderBy(*(order or columns)).select(*columns).collect()
    return [tuple(r) for r in rows]
