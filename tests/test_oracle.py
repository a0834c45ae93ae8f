"""Every registered query with SQL gives the same rows in DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from riskfabric.bindings import TABLES  # noqa: E402
from tools.check import compare  # noqa: E402

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, small_dir, duck, name):
    frame = entry.queries()[name](spark, small_dir)
    if name in ORACLES:
        _, problem = compare(frame, duck, ORACLES[name])
        assert not problem
    else:
        rows = frame.collect()
        assert rows and all(any(v is not None for v in r) for r in rows)
        assert all(any(r[c] is not None for r in rows) for c in frame.columns)


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert frame.columns[0] == "comp_id"


def test_every_query_with_sql_is_registered():
    assert set(ORACLES) <= set(entry.queries())
