"""Queries of the llm subpackage that SQL can express, against that SQL."""

import pytest

from quarrymill.llm import queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, small_dir, name):
    assert assert_same(queries.queries()[name](spark, small_dir), small_dir, queries.oracle_sql()[name]) > 0
