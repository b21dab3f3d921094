"""Every registered query against its SQL twin, and the row-only ones for rows."""

import pytest

import __spark_entry__ as entry
from comparing import database, differences

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.ORACLES
QUERIES = entry.QUERIES


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"anomaly_type", "severity", "count"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    found = differences(QUERIES[name](spark, SF_DIR), db, ORACLES[name])
    assert not found, found


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
