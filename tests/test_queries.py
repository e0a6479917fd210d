"""Every check query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, difference

from tallyspark.suite import registry

# a full run at another scale: ORACLE_SF_DIR=/root/testdata/sf0.01
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, db, name):
    problem = difference(db, registry.QUERIES[name](spark, FOLDER), registry.ORACLES[name])
    assert problem == "", problem


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
