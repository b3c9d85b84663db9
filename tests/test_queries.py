"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks.compare import check, database
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, sf, name):
    ok, note = check(spark, db, sf, name)
    assert ok, note


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(entry.oracle_sql())
