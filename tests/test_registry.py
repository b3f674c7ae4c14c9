"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from lorespark.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

#: Queries whose tables have too few rows at this size to mean anything, or that need minutes.
SLOW = {"intent_model"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert_same(df, sf_dir, ORACLE_SQL[name])
    else:
        assert df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
