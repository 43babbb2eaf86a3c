import os

import pytest

from lodewatch.plans import ORACLE_SQL, QUERIES
from tests.compare import connect, differences

#: TEST_SF_DIR names other tables.
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLE_SQL[name], SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
