"""Every query with check SQL gives the same rows as DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from oracle import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
# these run the whole job or slow filters; they are checked by properties instead
UNCHECKED = {"r3_mosaic", "e9_variants", "e8_smooth_combo"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    want = sql_rows(con, entry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - UNCHECKED))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
