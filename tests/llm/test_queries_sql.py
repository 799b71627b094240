"""Every registered query of the subpackage that SQL can express against its SQL, on whole small tables."""

import os

import pytest
from compare import connect, differences

from orderloom.llm.queries import CHECKS, QUERIES

FOLDER = os.environ.get("ORDERLOOM_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def checker():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, checker, name):
    assert differences(QUERIES[name](spark, FOLDER), checker, CHECKS[name]) == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
