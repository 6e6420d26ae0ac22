"""Every registered query of the library proper against its SQL."""

import pytest

from quarrymill.plans import registry
from tests.compare import assert_same

NAMES = sorted(registry.oracle_sql())
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small_dir, name):
    rows = assert_same(registry.queries()[name](spark, small_dir), small_dir, registry.oracle_sql()[name])
    assert rows > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, small_dir, name):
    assert registry.queries()[name](spark, small_dir).count() > 0
