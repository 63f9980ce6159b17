import pytest

from tests.oracle import compare
from tidemark.plans import catalogue, costs, reports, scans, values  # noqa: F401


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_against_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) > 0
