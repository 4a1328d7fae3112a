"""The hand-worked cases of the kernel."""

import pytest

from quillspan.plans.golden import ORACLE, QUERIES
from test_queries import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_golden(spark, name):
    duckdb = pytest.importorskip("duckdb")
    assert rows(QUERIES[name](spark, "").toPandas()) == rows(duckdb.connect().sql(ORACLE[name]).df())
