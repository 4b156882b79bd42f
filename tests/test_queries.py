"""Every registered query of the reference's families against its SQL on the smallest tables."""

import pytest

from harrow.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def db():
    return oracle.connect(oracle.DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert not oracle.difference(registry.QUERIES[name](spark, str(oracle.DATA)), db, registry.ORACLE_SQL[name])
