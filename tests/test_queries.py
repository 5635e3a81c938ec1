"""Every query against its SQL."""

import pytest

from folio.queries import ORACLE, QUERIES
from tests.compare import difference, oracle


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, connection, sf_dir, name):
    assert difference(spark, connection, QUERIES[name], ORACLE[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
