"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare_query
from __spark_entry__ import oracle_sql, queries

@pytest.mark.parametrize("name", sorted(n for n in queries() if n in oracle_sql()))
def test_query(spark, sf_dir, name):
    compare_query(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)


def test_every_query_is_checked():
    own = {n for n in queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(oracle_sql())
