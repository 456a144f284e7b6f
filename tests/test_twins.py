"""Every registered query against its SQL twin on the smallest test data."""

import duckdb
import pytest

from checks import compare
from checks.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in compare.TABLES.split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        assert got == compare.twin(con, ORACLES[name])
    else:
        assert got[1]
