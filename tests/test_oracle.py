"""Every registered query against its DuckDB text on the shared tables."""

import os

import pytest

from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    if name in oracle_sql():
        assert differences(df, duck, oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_gives_cities(spark):
    out = entry(spark)
    assert out.columns == ["city", "avg_value", "avg_tax", "avg_psf", "n"]
    rows = out.collect()
    assert 0 < len(rows) <= 15
    assert [r.avg_value for r in rows] == sorted((r.avg_value for r in rows), reverse=True)
