"""Every registered query of the library against DuckDB, or for rows where SQL cannot say the same."""

import math
import os
from pathlib import Path

import pytest

from weftline.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.5f}"
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(frame.columns)
    return columns, sorted([cell(x) for x in row] for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
