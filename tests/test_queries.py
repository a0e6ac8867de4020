"""Every query of the tariff engine beside its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from compare import TABLES, rows
from wattgrid.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got.columns) > 1


def test_every_query_has_rows():
    """A comparison of no rows with no rows says nothing, so each query's SQL has some on the next larger tables."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    assert [name for name in sorted(ORACLES) if not c.execute(f"select 1 from ({ORACLES[name]}) limit 1").fetchall()] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= len(QUERIES)
