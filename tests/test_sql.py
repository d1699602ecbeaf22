import pytest

from dokuma.plans import registry
from tests.oracle import FOLDER, connect, same

CON = connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    same(registry.queries()[name](spark, FOLDER), CON, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).columns


def test_flagship(spark):
    row = registry.flagship(spark, FOLDER).first()
    assert row.docs > 50 and row.total_tokens > row.unk_count > 0
