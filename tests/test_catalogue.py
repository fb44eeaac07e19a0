import pytest

from auditframe import registry
from tests.compare import same

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    same(registry.queries()[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_other_queries_run(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.count() >= 0 and df.columns


def test_flagship_has_rows(spark, data):
    assert registry.flagship(spark, data).count() > 0
