"""Registered queries of the package that SQL can express."""

import pytest

from lineamix.llm.catalog import ORACLE, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query(spark, sf_dir, key):
    assert not differences(QUERIES[key](spark, sf_dir), connect(sf_dir), ORACLE[key])
