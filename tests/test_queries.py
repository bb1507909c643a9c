"""Every registered query against its DuckDB oracle (the driver's gate, on sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from support import SF_SMALL
from scripts.check_queries import TABLES, canon
from veloscore.plans import catalog

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_but_timing_has_an_oracle():
    """Of the library's own catalog; queries that other modules add have tests of their own."""
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(catalog.QUERIES) - set(ORACLE) == {"timed_runs"}


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows, name
    if name not in ORACLE:
        return
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon(rows, df.columns) == canon(rel.fetchall(), rel.columns)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["row_no", "unix_time", "key", "predicted", "actual", "line"]
    assert df.count() > 0
